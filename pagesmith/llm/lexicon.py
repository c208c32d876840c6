"""Fixed values of the text problems: frequent words of the languages, and sentences to train on. All stated as plain text."""

from __future__ import annotations

LANGUAGES = ("en", "hi", "mr", "fr", "de", "es", "ta", "ur", "zh", "ja", "th", "ru")

# Frequent function words, by language; hi-Latn is Hindi in Latin letters.
FREQUENT = {
    "en": "the of and to in a is was were that for on with as by at from it be this are not which or an have had has been but its who they their will would shall should can cannot must may if when where whoever whose because although between under before after about into than then there these those every each none only very again still also both other such more most some any no one two your you we our he she his her them please how what why",
    "fr": "le la les des du de un une et est sont a ont été être avoir que qui dans pour par sur au aux avec ce cette ces son sa ses leur leurs ne pas plus ou où mais comme si se il elle ils elles nous vous on lui entre sous après avant cet dont aucune aucun toute tout toutes tous d'être l' n'a doit sans chez depuis votre veuillez même très peu bien encore déjà avait selon fut deux cent rien sont-elles qu'il c'est d'un d'une",
    "de": "der die das den dem des ein eine einer eines einem einen und ist sind war waren wird werden wurde wurden nicht mit von zu zum zur im in am an auf aus bei nach vor über unter durch für als auch noch nur sich es er sie wir ihr wer hat haben hatte hatten dass daß wenn weil obwohl bevor wie was keine keiner oder aber um bis muss müssen kann können binnen dieser diese dieses diesem sehr mehr schon bitte seite gemäß ins dann so wieder hier dort zusammen",
    "es": "el la los las de del un una unos unas y es son fue fueron que en por para con al se no más o pero como si su sus lo le les ha han había este esta estos estas entre sin sobre hasta desde también muy ya cuando donde quien cual todo toda todos todas ninguna ninguno otro otra otras otros antes después según junto hay está están sido ser aún solo sólo plazo deberá a las nadie gracias uno dos porque cada sigue siguen véase",
    "hi": "का के की को में से पर और है हैं था थे थी यह वह ये वे इस उस ने कि जो तो भी ही नहीं एक कर करके किया किए गया गई गए हो होगा जाए जाएगा जाता क्या सभी अपने साथ लिए बाद पहले यदि कोई वाला वाले अब तक कहाँ कहा बताया रहा रही रहे दिया देता करता आप हम कृपया कुछ बड़े दर्ज अनुसार नई",
    "mr": "आणि आहे आहेत होते होती होता या हा ही हे ते तो ती च्या चे ची चा मध्ये वर ने ला असे असा असलेला असलेली की का नाही नाहीत एक येथील येथे आता सर्व सोबत म्हणजे जास्त मते यांनी यांच्या सांगितले विचारले पाहिजे करावा करावे आत पूर्वी कुठे जुना जुन्या आलेल्या केला केली पण आपण कृपया परत पाठवला",
    "hi-Latn": "hai hain ka ki ke ko ne mein se par aur ek yeh ye woh vah kya nahin nahi tha thi ho to ab agar jo is us uske uski iska iski inki wala wale wali gaya gayi gaye kiya kiye raha rahi rahe sabhi saath koi bade purana purani naya nayi yahan wahan kaha bataya liye tak bhi hi jab tab lekin kyunki apna apne hum aap mujhe unka jayega jaye jata kuch bahut din baad rakha lautaya padhkar dekha daftar kagaz jaanch ki kis kaun kahan kab pehle phir sab log kar karke diya diye lage hue hua hui",
}

# Sentences of everyday and office prose, by language, to train on beside the corpus.
SENTENCES = {
    "hi-Latn": """Mujhe yeh kitab kal tak wapas chahiye aur koi galti nahin honi chahiye.
Samiti ne sabhi kagaz dekhkar faisla kiya ki kaam agle hafte shuru hoga.
Kya aapne naya patra padha hai jo daftar se aaya tha?
Agar koi sawal ho to hamare daftar mein aakar puchh lijiye.
Yeh purani tasveer bade kamre mein deewar par lagi hui hai.
Unhone kaha ki register ab yahan nahin milega.
Adhikari ne bataya ki vazan pehle se zyada hai.
Sabhi aavedan dinon ke andar lautaye jayenge.
Hum log kal subah bazaar gaye the aur bahut saman kharida.
Is varsh ki suchi mein naye naam jode gaye hain.
Pustakalaya ki purani kitabein ab nayi almari mein rakhi gayi hain.
Kripya apna pramanpatra aur naksha saath lekar aaiye.
Kramank wala dastavez bade daftar mein surakshit hai aur uski do pratiyan hain.
Varshik abhilekh ki jaanch abhi tak puri nahin hui thi.
Gaon ke log kehte hain ki yeh sadak bahut purani hai.
Bachche school se laut kar khana kha rahe the.""",
    "en": """Please sign in again to continue.
Your session has expired and the page could not be displayed.
Type your text here and press the button to go on.
Access to this document was denied by the server.
The children walked home from school before the rain began.
A new road will be built along the river next year.
He asked who had written the letter and when it arrived.
We thank you for your request, which has reached our office.
Copies go to the head of the department.
Signed at noon by the keeper of the records.
Page not found.
Do not close this window while the file is being saved.""",
    "fr": """Veuillez activer les scripts pour afficher ce document.
La page demandée est introuvable sur ce serveur.
Saisissez votre texte dans ce cadre.
Les enfants sont rentrés de l'école avant la pluie.
Une nouvelle route sera construite le long du fleuve l'année prochaine.
Votre session a expiré, merci de vous reconnecter.""",
    "de": """Bitte schalten Sie die Skripte ein, um diese Seite zu sehen.
Die angeforderte Seite wurde nicht gefunden.
Hier steht Ihr Text.
Die Kinder gingen vor dem Regen von der Schule nach Hause.
Im nächsten Jahr wird eine neue Straße am Fluss gebaut.
Zugriff verweigert.
Ihre Sitzung ist abgelaufen, melden Sie sich erneut an.""",
    "es": """Active los scripts para ver este documento.
No se encontró la página solicitada en este servidor.
Escriba aquí su texto.
Los niños volvieron de la escuela antes de la lluvia.
El año próximo se construirá una carretera nueva junto al río.
Acceso denegado.
Su sesión ha caducado y debe iniciarla de nuevo.""",
    "hi": """कृपया इस पृष्ठ को देखने के लिए स्क्रिप्ट चालू करें।
अनुरोधित पृष्ठ नहीं मिला।
बच्चे बारिश से पहले स्कूल से घर लौट आए।
अगले साल नदी के किनारे एक नई सड़क बनाई जाएगी।""",
    "mr": """कृपया हे पान पाहण्यासाठी स्क्रिप्ट सुरू करा.
मागितलेले पान सापडले नाही.
मुले पावसाच्या आधी शाळेतून घरी परत आली.
पुढच्या वर्षी नदीच्या काठी नवा रस्ता बांधला जाईल.""",
}
# Words that are no language's, to train the label of none.
NO_LANGUAGE = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure reprehenderit voluptate velit esse
cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum vivamus sagittis bibendum quisque ornare
asdf qwer qwerty zxcv asdfgh xxxx xxxxx xxx blah foo bar baz undefined null nan tbd todo xyz abc object""".split()
