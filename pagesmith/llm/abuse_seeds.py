"""Labelled sentences to train on. TOXIC: every token is part of an insult, hatred of a group or explicit sex. CLEAN: sober or technical use of the same words, and ordinary prose."""

TOXIC = {
    "insult": """You are a worthless idiot and everybody laughs at you.
Shut your mouth, you stupid pig.
What a pathetic loser you are, you moron.
He is a filthy bastard and deserves to be beaten.
She is a stupid cow and a lying rat.
Go kill yourself, nobody here wants you.
I hope that scumbag chokes on his dinner.
You braindead clown, nobody wants to read your garbage.
This office is run by imbeciles and cretins, damn them all to hell.
Crawl back into your hole, you dumbass parasite.
Drop dead, you piece of shit, we all hate you.
That bitch should be slapped in the face.
Fuck you, you fucking asshole.""",
    "hate": """Those people are vermin and should be driven out of the country.
All of them are born thieves, never hire one of that kind.
Somebody should burn down the houses of those dirty strangers.
They breed like rats, get rid of them.
No decent town should let this subhuman filth live in it.
Throw the whole dirty tribe out before they steal everything.
That race is inferior and must be wiped out.""",
    "sex": """They had wild sex on the floor until morning.
She was naked and moaned while he licked her skin.
Send me nude pictures, I am so horny tonight.
Hot naked singles are waiting for you, watch the xxx clips.
He pulled off her shirt and begged for more.
They screwed all night and her orgasm woke the house.
He fucked her hard while she begged for more.""",
    "fr": """Ferme ta gueule, espèce d'abruti, personne ne veut de toi.
Tu es un sale con et un imbécile.
Ces gens sont de la vermine, il faut les chasser du pays.
Elle était nue et ils ont fait l'amour comme des bêtes.
Va crever, pauvre idiot, tout le monde te déteste.""",
    "de": """Halt die Klappe, du Vollidiot, keiner kann dich ausstehen.
Er ist ein dreckiger Mistkerl und gehört verprügelt.
Diese Leute sind Ungeziefer und müssen aus dem Land verschwinden.
Sie war nackt und stöhnte, während er sie auf dem Bett nahm.
Verreck doch, du blöde Sau, alle hassen dich.""",
    "es": """Cállate, imbécil, nadie te soporta.
Eres un idiota y un pedazo de basura.
Esa gente son ratas y hay que echarlos del país.
Estaba desnuda y gemía de placer mientras él la besaba.
Ojalá te mueras, hijo de puta, todos te odian.""",
    "hi": """चुप रहो, बेवकूफ़ गधे, तुम्हें कोई नहीं सुनना चाहता।
वह एक कमीना है और उसे पीटना चाहिए।
ये सब लोग कीड़े हैं, इन्हें देश से निकाल दो।
तू एक नीच कुत्ता है, मर जा।""",
    "mr": """गप्प बस मूर्खा, तुझे कोणीही ऐकत नाही.
हे सर्व लोक किडे आहेत, त्यांना गावातून हाकला.
तो एक हरामखोर आहे आणि त्याला मारले पाहिजे.""",
    "ur": """چپ رہو، بیوقوف گدھے، تمہیں کوئی نہیں سننا چاہتا۔
یہ سب لوگ کیڑے ہیں، انہیں شہر سے نکال دو۔
وہ ایک کمینہ ہے اور اسے پیٹنا چاہیے۔""",
    "ta": """வாயை மூடு முட்டாளே, உன்னை யாரும் கேட்க விரும்பவில்லை.
இவர்கள் எல்லாம் பூச்சிகள், ஊரை விட்டு துரத்துங்கள்.
அவன் ஒரு கேடுகெட்ட நாய், அவனை அடிக்க வேண்டும்.""",
    "zh": """闭嘴，你这个白痴，没人想听你说话。
这些人都是害虫，应该把他们赶出城去。
你是个混蛋，去死吧。
她赤身裸体，呻吟着求他继续。""",
    "ja": """黙れ、この馬鹿野郎、誰もお前の話なんか聞きたくない。
あいつらは害虫だ、町から追い出せ。
死ね、クズ野郎。""",
    "th": """หุบปากไอ้โง่ไม่มีใครอยากฟังแก
พวกมันเป็นสัตว์รกต้องไล่ออกจากเมือง
ไอ้เลวแกสมควรโดนตบ""",
    "ru": """Заткнись, тупой идиот, тебя тут все ненавидят.
Эти люди — паразиты, гоните их из города.
Он мерзкий ублюдок и заслуживает побоев.""",
    "short": """Fuck you. Fuck off. Fucking asshole. Asshole! Idiot! You idiot. Moron! You moron. Bastard! Bitch! Stupid bitch! Scumbag! Whore! Dumbass! Piss off. You pig. Stupid cow.
Du Arschloch! Arschloch! Wichser! Du Idiot! Du Schlampe! Blöde Sau! Vollidiot! Fick dich. Missgeburt! Du Mistkerl!
Connard! Salope! Sale con. Ta gueule! Abruti! Imbécile! Pauvre idiot. ¡Imbécil! ¡Idiota! ¡Cabrón! ¡Puta! Eres idiota. Vete a la mierda.
Идиот! Ублюдок! Тупой идиот! Сука! कमीने! हरामखोर! मूर्ख कुत्ता! بیوقوف! முட்டாள்! 白痴。 混蛋。 馬鹿。 クズ。""",
}
CLEAN = """The rules forbid insulting a colleague and describe the procedure for complaints.
To stop the scan, kill the process and restart the dumb terminal.
A tribunal heard that he had used an abusive word and imposed a fine.
Vermin control in the grain store was renewed last year.
Use a bastard file for the edge and tighten each screw of the cockpit frame.
The nude figure in the plate was drawn after a plaster cast.
The idiot-proof cover of the machine was designed by the workshop.
The table gives the sex ratio of births for the year.
The bitch whelped seven pups at the kennel.
The study counts hateful remarks about minorities in letters to the editor.
The cock of the boiler must be shut before the assessment begins.
The clinic offers breast cancer screening and advice on sexual health.
The report describes how the police dealt with threats and hate speech.
Rats were caught in the cellar and the houses were cleaned.
The children watched the naked branches of the trees until dawn.
The court fined the paper for printing a racial slur.
The lesson explains sexual reproduction in plants.
La loi punit l'insulte et la discrimination des minorités.
Das Gericht verurteilte den Mann wegen Beleidigung eines Beamten.
El estudio analiza los insultos en la prensa del siglo pasado.
रिपोर्ट में अपमानजनक शब्दों की शिकायतों का अध्ययन किया गया है।
该报告研究了网络上的仇恨言论。
В отчёте изучаются жалобы на оскорбления.
この報告書は差別的な発言について調査したものです。
Thank you. Thanks. You. You are. Are you? And you? See you. You too. Go. Go on. Yes. No. Hello! Read it. Shut it. Shut up shop. Up. Mouth. Kill process. Kill it. Everybody laughs. Everybody. Stupid question. Dumb terminal. Pig. Cow. Rat. Rats. Dog. He is. She was. They are. Nobody. People. What? Why? Here. Pigs and cows. Man. That man. Your mouth. Off. Get up. Sit down. Come back. Hate speech. Insult. Naked. Bed. Sex. Wet.
Danke. Ja. Nein. Hallo! Er ist. Merci. Tu es. Et toi? Oui. Non. Bonjour! Gracias. Y tú. Eres tú. Sí. Hola! Ты. Спасибо. Да. Нет. Люди. तू। तुम। धन्यवाद। कुत्ता। हाँ। تم۔ شکریہ۔ நன்றி। 你。 谢谢。 是。 ありがとう。 はい。"""

# Names that people are called, and sentences that call them so.
NAMES = ["idiot", "moron", "imbecile", "cretin", "dumbass", "bastard", "scumbag", "pathetic loser", "braindead clown", "filthy pig", "lying rat", "worthless parasite", "stupid cow", "piece of garbage"]
FRAMES = ["That man is a {0} and deserves a beating.", "Shut up, you {0}, and crawl back to where you came from.", "What kind of {0} does such a thing, you {1}?", "You {0}, nobody here wants to hear your rubbish.", "I hope he chokes on it, that {0}.", "They are run by one {0} after another.", "Go and kill yourself, you {0}, everyone hates you."]

# Words of address, which alone are no insult.
ADDRESS = frozenset("you your are is u du dich dir bist ist sie tu te toi es vous et and y tú eres usted ты вы तू तुम आप تم تو நீ 你 您 お前".split())
