"""Problem 2: leftovers of templates, filler and messages of servers and browsers, by a regularized linear classifier.

A region is cut into units: the sentences of its content, and those of every
block or cell of its html, at final marks and line breaks. Features of a unit
are hashed n-grams of its words (of its characters in scripts without spaces),
in which placeholders and status codes are reduced to their kind, its length,
how far its words repeat, and whether it is a title or heading of the html.

Labels are weak: shapes of placeholders, response statuses, phrases of notices,
words of filler text and repetition; a mark that is spoken about - that words
of explaining stand beside - is none. They are completed by fixed sentences, by
placeholders put into ordinary sentences, and by frames that speak about one.
Two things are held out to validate, and published by ``report``: jobs (the
hosts here), a fifth by digest; and whole families of phrases and placeholders,
left out of a second fit.

The model is fitted on the driver on a bounded sample (TRAIN_REGIONS) and on
fixed sentences. {{EQ:n}} is no residue. Null, empty and blank contents and
htmls have no units; a region is residue if any of its units is.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesmith.llm.common import Shared, bounded_sample, fold_words, map_arrow, strip_invisible

BITS = 18
MASK = (1 << BITS) - 1
#: Regions of the sample that the model is fitted on.
TRAIN_REGIONS = 16_000
#: Ordinary units of the sample that get a placeholder for a word, and that get a status for a number, to train on.
AUGMENTED = 2500
# How placeholders open and close, by family, and what templates leave behind where a value was missing.
BRACKETS = {"braces": [("{{", "}}"), ("{{ ", " }}"), ("${", "}"), ("#{", "}"), ("{$", "}"), ("{", "}")], "percent": [("<%= ", " %>"), ("{% ", " %}"), ("[% ", " %]"), ("%", "%")], "angles": [("<<", ">>"), ("«", "»")], "doubled": [("[[", "]]"), ("((", "))"), ("@@", "@@"), ("__", "__"), ("$", "$")]}
NAMES = ["name", "customer_name", "DATE", "row.total", "orderId", "ADDRESS", "user.email", "amount", "FIRST_NAME", "title", "invoice.no", "dueDate"]
EMPTY = ["(null)", "undefined", "[object Object]", "#REF!", "#VALUE!", "NaN", "{0}", "{2}"]
REQUESTS = ["[insert figure]", "[company name]", "[INSERT DATE HERE]", "[to be completed]", "[Your Name]", "[Enter title]", "[add address]", "[type text here]"]

_CAPS = r"[A-Z][A-Z0-9_.]+"
_TEMPLATE = re.compile(rf"\{{\{{(?!\s*EQ:\d+\s*\}}\}}).{{0,80}}?\}}\}}|\{{%.{{0,80}}?%\}}|[$#]\{{[^}}\n]{{0,60}}\}}|\{{\$?[A-Za-z_][\w.]*\}}|<%.{{0,80}}?%>|<<\s*[\w. ]{{1,60}}\s*>>|«[\w.]{{2,40}}»|%{_CAPS}%|\$\w*{_CAPS}\$|__[A-Za-z][A-Za-z0-9_.]*__|\[%.{{0,60}}?%\]|\[\[\s*[\w. ]{{1,40}}\s*\]\]|\(\(\s*[\w. ]{{1,40}}\s*\)\)|@@\s*[\w. ]{{1,40}}\s*@@")
_NULLS = re.compile(r"\(null\)|\[object Object\]|\bundefined\b|\bNaN\b|#(?:REF|VALUE|NAME|DIV/0|NUM|NULL|N/A)[!?]?")
_BRACKET = re.compile(r"\[(?:[^\W\d_]+[ _]?){1,6}\]")
# What a bracket that asks for something starts with.
_REQUEST = re.compile(r"\[\s*(?:insert|enter|your|company|to be|add|type|name|date|title|customer|recipient|address|fill|put|choose|select|click)\b[^\[\]\n]{0,60}\]", re.I)
_BRACE = re.compile(r"\{\d+\}")
# Response statuses of failures.
_STATUS = re.compile(r"(?<![\d./-])(?:40[0-9]|41[0-8]|42[1-9]|431|451|50[0-8]|51[01]|52[0-6])(?![\d/-])")
_EQ = re.compile(r"\{\{\s*EQ:\d+\s*\}\}")
_BREAK = re.compile(r"</?(?:p|div|td|th|tr|table|li|ul|ol|h[1-6]|title|body|html|head|br|hr|noscript|section|article|caption|pre|blockquote)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_SCRIPT = re.compile(r"<(script|style)\b.*?</\1\s*>", re.I | re.S)
_HEAD = re.compile(r"<(title|h[1-6])\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_WORD = re.compile(r"⟨\w+⟩|[\u3040-\u30ff\u3400-\u9fff]+|[\u0e00-\u0e7f]+|[^\W\d_][\w\u0300-\u036f\u0900-\u0903\u093a-\u094f\u0962\u0963\u0b82-\u0bcd'’]*|\d+|[#%]")
_NO_SPACES = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]")

# Words of filler text.
_FILLER = frozenset("""lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint
occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas
vestibulum vivamus sagittis bibendum quisque ornare asdf qwer zxcv qwerty asdfgh xxx xxxx xxxxx xxxxxx blah tbd todo tba""".split())
# Words of explaining, by which a weak label takes a mark for one that is spoken about. They are no feature.
_ABOUT = re.compile(r"\b(?:signs?|symbol|stands? for|tells?|learners?|notation|means?|meant|explains?|manual|guide|teach(?:es)?|taught|course|specimen|advis\w+|handbook|lesson|according to|describes?|discuss\w*|example|such as|for instance|called|writes?|syntax|bedeutet|erklärt|zeichen|signifie|explique|signe|significa|explica|signo)\b|अर्थ|चिह्न|означает|знак|表示|意味", re.I)
# Phrases of notices, of instructions in empty forms and of filler, in lower case.
NOTICES = """enable javascript|javascript is disabled|javascript aktivieren|javascript ein|activer javascript|active javascript|javascriptを有効|启用javascript|जावास्क्रिप्ट चालू
session has expired|sign in again|log in again|session a expiré|vous reconnecter|sitzung ist abgelaufen|sesión ha caducado|sesión ha expirado
access denied|permission to open this|permission to access|zugriff verweigert|accès refusé|accès interdit|acceso denegado
page could not be displayed|page you requested|requested page|page not found|page demandée est introuvable|seite wurde nicht gefunden|no se encuentra la página|página solicitada|页面不存在|ページが見つかりません|पृष्ठ नहीं मिला|unable to connect
no longer available|try again later|bitte versuchen sie es|réessayer plus tard|inténtelo de nuevo|बाद में प्रयास करें|सर्वर से संपर्क|server did not answer|servicio no está disponible|service unavailable|bad gateway|gateway timeout|internal server error
your browser does not support|checking your browser|requires scripts|turn them on and reload|switch scripting on|scripting is off|accept all cookies|we use cookies|address has been blocked|too many requests|unhandled exception|contact the administrator|fatal error|stack trace
text goes here|your text here|type your|click to add|click here to|insert a short description|insert text|only here to show the layout|will be replaced|sample text sample text|cell text|placeholder text
saisissez votre texte|texte à venir|escriba aquí|hier steht ihr text|text hier eingeben|hier text|ここに本文|本文を入力|在此输入|यहाँ अपना पाठ|नमूना पाठ नमूना|texto texto|texte texte|text text text"""
_NOTICE = re.compile("|".join(re.escape(p) for line in NOTICES.split("\n") for p in line.split("|")))
# What stands before or after a response status.
_ERROR = r"(?:error|http|status|code|fehler|erreur|código|ошибка|त्रुटि|错误|エラー|خرابی|பிழை|ข้อผิดพลาด)"
_STATUS_FIRST = re.compile(rf"^(?:{_ERROR}\W{{0,3}})?⟨status⟩\W+(?:[a-z]+\s+)?(?:not found|forbidden|unauthorized|bad|gateway|service|internal|request|payment|gone|too many|unavailable|timeout)|^{_ERROR}\W{{0,3}}⟨status⟩")
_STATUS_NAMED = re.compile(rf"{_ERROR}\W{{0,3}}⟨status⟩\s*[:：–-]")

# Sentences to train on besides the sample; residue, and sentences that only speak about such things.
RESIDUE = """Please enable JavaScript to view this page.|You need to enable JavaScript to run this site.|Bitte schalten Sie JavaScript ein, um diese Seite zu sehen.|Veuillez activer JavaScript pour afficher ce document.|Active JavaScript en su navegador para ver esta página.
このページを表示するにはJavaScriptを有効にしてください。|请启用JavaScript以浏览本页内容。|इस पृष्ठ को देखने के लिए कृपया जावास्क्रिप्ट चालू करें।|Пожалуйста, включите JavaScript, чтобы открыть страницу.|இந்தப் பக்கத்தைப் பார்க்க JavaScript ஐ இயக்கவும்.|براہ کرم جاوا اسکرپٹ فعال کریں۔|กรุณาเปิดใช้งาน JavaScript เพื่อดูหน้านี้
Error 404: the page was not found.|404 Not Found|403 Forbidden|500 Internal Server Error|502 Bad Gateway|503 Service Unavailable|504 Gateway Timeout|Fehler 404: Die Seite wurde nicht gefunden.|Erreur 404 : la page demandée est introuvable.|Error 404: no se encuentra la página solicitada.|错误404：您访问的页面不存在。|エラー404：ページが見つかりません。|त्रुटि 404: माँगा गया पृष्ठ नहीं मिला।|Ошибка 404: страница не найдена.
Access denied.|You do not have permission to open this file on this server.|Zugriff verweigert.|Accès refusé.|Acceso denegado.|Your session has expired.|Sign in again to continue.|Votre session a expiré.|Veuillez vous reconnecter pour continuer.|Ihre Sitzung ist abgelaufen.|Su sesión ha caducado.
We are sorry, this document is no longer available.|The requested page could not be displayed.|Please try again later.|Inténtelo de nuevo más tarde.|El servicio no está disponible en este momento.|Bitte versuchen Sie es später noch einmal.|कृपया बाद में प्रयास करें।|सर्वर से संपर्क नहीं हो सका।|The server did not answer in time.|The service is temporarily unavailable.
Your browser does not support the features needed here.|Update it or switch scripting on.|Checking your browser before the document opens.|This takes about 5 seconds.|This site requires scripts.|Turn them on and reload.|We use cookies.|Accept all cookies to go on reading.|Too many requests.|Your address has been blocked for 30 seconds.|Unhandled exception in module page at line 12|Contact the administrator.
Text goes here.|Your text here|Cell text|Type your introduction here.|Click to add title|Click to add subtitle|Insert a short description of the project in this place.|This paragraph is only here to show the layout and will be replaced.|Saisissez votre texte dans ce cadre.|Texte à venir.|Escriba aquí el texto del capítulo.|Hier steht Ihr Text.|ここに本文を入力してください。|在此输入正文。|यहाँ अपना पाठ लिखें
Lorem ipsum dolor sit amet, consectetur adipiscing elit.|Vestibulum morbi tristique senectus et netus.|xxxx xxxx xxxx|xxxxx|asdf asdf qwer|blah blah blah|TBD TBD TBD|n.n.|texto texto texto texto|नमूना पाठ नमूना पाठ
${name}|{{customer}}|<%= title %>|%NAME%|<<date>>|«date»|[Enter title]|[insert figure]|[INSERT DATE HERE]|[company name]|{0}|{% if approved %}|{% include header %}|__AUTHOR__|(null)|undefined|NaN|[object Object]|#REF!|#VALUE!
Dear ${name}, your request of {{date}} has reached our office.|Dear [Your Name],|Thank you, {0}, for sending the form to our branch.|Signed at {{place}} by the head of %DEPARTMENT%.|This agreement is made between <<name>> and [company name] on ${date}.|Copies go to (null).|Page total: {2}|None of the 16 ${title} mentions the register.|Sie finden die «name» im Archiv.|Le {{title}} est conservé avec les lettres."""
RESIDUE += """
The server is overloaded.|Service temporarily overloaded, retry later.|Der Server ist überlastet.|Le serveur est surchargé.|El servidor está sobrecargado.|Сервер перегружен.|服务器繁忙，请稍后再试。|サーバーが混み合っています。|सर्वर पर बहुत भार है।
Page not found.|Pagina non trovata.|Página não encontrada.|Страница не найдена.|Pagina niet gevonden.|الصفحة غير موجودة|ページが見つかりません。|页面未找到。|Die angeforderte Seite existiert nicht.|Cette page n'existe pas.|Esta página no existe.
Coming soon|Under construction|This page is under construction.|In Kürze verfügbar|Bientôt disponible|Próximamente|Скоро|敬请期待|準備中|Loading, please wait...|Loading...|Chargement en cours...|Wird geladen...|Cargando...|Загрузка...
Cookies must be enabled to continue.|Please verify that you are human.|Complete the captcha to proceed.|Connection timed out.|Connection reset by peer.|The request could not be processed.|An unexpected error has occurred.|Something went wrong.|Ein Fehler ist aufgetreten.|Une erreur est survenue.|Ha ocurrido un error.|Произошла ошибка.|发生错误。|エラーが発生しました。|एक त्रुटि हुई है।
We are down for maintenance.|Wartungsarbeiten|Maintenance en cours|Sitio en mantenimiento|You must be logged in to view this page.|Bitte melden Sie sich an.|Veuillez vous identifier.|Debe iniciar sesión.|请先登录。|ログインしてください。|Доступ запрещён.|Доступ закрыт.|访问被拒绝。|アクセスが拒否されました。|پہنچ سے انکار|அணுகல் மறுக்கப்பட்டது|ไม่พบหน้านี้|பக்கம் கிடைக்கவில்லை
No content available.|No description provided.|Add your text here.|Replace this text with your own.|This is a sample paragraph.|Insert your content here.|Fügen Sie hier Ihren Text ein.|Ajoutez votre texte ici.|Añada aquí su texto.|Вставьте текст сюда.|Введите текст|Здесь будет текст.|Your company name here|Delete this line before printing."""
# Frames that speak about a mark, which takes the place of the braces.
FRAMES = """The mark {} is explained in the first lesson.|Write {} where the name is to go, the handbook says.|The author discusses {} in a footnote on syntax.|In this notation {} means an empty field.|The sign {} stands for the day of the meeting.|Pupils learn that {} is called a placeholder.|The chapter on forms shows {} as an example.|A program replaces {} with the value of the field.|The guide advises to keep {} in capitals.
Das Zeichen {} bedeutet, dass ein Wert fehlt.|Die Anleitung erklärt, wofür {} steht.|Le signe {} signifie que la valeur manque.|Le manuel explique à quoi sert {}.|El signo {} significa que falta un valor.|La guía explica para qué sirve {}.|चिह्न {} का अर्थ है कि मान नहीं है।|Знак {} означает пустое поле.|记号{}表示空白的栏目。|記号{}は空欄を意味する。"""

ABOUT = """The sign ${date} on the specimen stands for the day of signature.|The guide tells learners to write [Your Name] in the upper corner.|The manual explains that error 404 means a missing sheet in drawer 4.|Form 404 was not found in the inspection of the office.|In set notation {1, 2} and {0} are disjoint, as the teacher showed.
Printers set the words lorem ipsum in a specimen of 1969.|Chapter 25 explains why a blank page shows sample text in grey letters.|The course teaches JavaScript and the printing of a form.|The server of the court carried the bibliography by hand.|The template of the schedule has a blank for the date and a blank for the place.
If a screen asks to enable scripts, the manual advises to print the sheet again.|Visitors without permission were denied access to the archive in 1986.|The price rose to $808 per archive, or 11% more.|The area follows from {{EQ:0}} once {{EQ:1}} is known.|By {{EQ:0}} the pressure falls by 42.89 percent.|The handbook describes how a browser asks for cookies.|The session of the council expired at noon and was not continued.|The page was not found in the second volume.
The text on the left page is printed in grey.|Room 503 was not available in October.|The committee read 404 pages and found 12 errors.|Please return the form to the office.|The office closes at 5 p.m. and opens again at 8 a.m.|Insert the key and turn it twice, the manual says.|The document was returned to the office within 30 days.|None of the letters mentions the register [see note 4].|xvi|iv|LXII|p. 22|- 13 -|Page 7 of 12|12|A.|B|Fig. 3|Index|Table IV"""


_BROKEN = re.compile(r"-\n(?=[^\W\d_])")
#: Line breaks within a running sentence: the line does not end one, and the next does not start in upper case.
_JOINED = re.compile(r"(?<![.!?:。！？।۔\n])\n(?=[^\W\d_A-ZÀ-ÞА-Я])")


def blocks_of(content: str | None, html: str | None) -> list[tuple[str, bool]]:
    """Texts of content and of html's blocks and cells; True: a title or heading of html."""
    blocks: list[tuple[str, bool]] = []
    if content and not content.isspace():
        blocks.append((re.sub(r"</?[bi]>", "", content), False))
    if html and not html.isspace():
        h = _SCRIPT.sub(" ", re.sub(r"<<([\w. ]+)>>", r"&lt;&lt;\1&gt;&gt;", html))
        heads = {re.sub(r"\s+", " ", _TAG.sub("", m.group(2))).strip() for m in _HEAD.finditer(h)}
        for part in _BREAK.split(h):
            t = html_lib.unescape(_TAG.sub("", part)).strip()
            if t:
                blocks.append((t, t in heads))
    return [(_JOINED.sub(" ", _BROKEN.sub("", b)) if "\n" in b else b, t) for b, t in blocks if any(c.isalpha() or c in "#{%" for c in b)]


_UNIT_END = re.compile(r"[.!?…][\"'”»)\]]*\s+|[。！？।۔؟][”」』）]*\s*|\n+")
_INITIAL = re.compile(r"(?:^|[^\w])[^\W\d_]$")


def cut_block(b: str) -> list[str]:
    """A block's units: cut at final marks and line breaks that no placeholder holds; what has no letter stays with what stands before it."""
    if not (cuts := [m.span() for m in _UNIT_END.finditer(b)]):
        return [b]
    held = [m.span() for m in _TEMPLATE.finditer(b)] if any(c in b for c in "{%<«[(@$_") else []
    out, at = [], 0
    for p, q in cuts:
        if not any(x < q and p < y for x, y in held) and not (b[p] == "." and _INITIAL.search(b[max(0, p - 2) : p])):
            out.append(b[at:q].strip())
            at = q
    out.append(b[at:].strip())
    return [x for x in out if x]


def units_of(rows: list[tuple[str | None, str | None]]) -> list[list[tuple[str, bool]]]:
    """Of each (content, html) the units of content and of html's blocks and cells."""
    return [[(u, t) for b, t in blocks_of(c, h) for u in cut_block(b)] for c, h in rows]


def units(content: str | None, html: str | None) -> list[tuple[str, bool]]:
    return units_of([(content, html)])[0]


def reduced(unit: str) -> str:
    u = fold_words(strip_invisible(unit))
    if any(c in u for c in "{}$%<[«(#_") or "undefined" in u or "NaN" in u:
        u = _EQ.sub(" ", u)
        u = _BRACE.sub(" ⟨brace⟩ ", _BRACKET.sub(" ⟨bracket⟩ ", _REQUEST.sub(" ⟨request⟩ ", _NULLS.sub(" ⟨null⟩ ", _TEMPLATE.sub(" ⟨template⟩ ", u)))))
    return _STATUS.sub(" ⟨status⟩ ", u)


_SPLIT: dict[str, tuple[str, ...]] = {}


def _parts(w: str) -> tuple[str, ...]:
    out = tuple(w[i : i + 2] for i in range(max(1, len(w) - 1))) if _NO_SPACES.match(w) else ("0",) if w.isdigit() else (w.lower(),)
    if len(_SPLIT) > 300_000:
        _SPLIT.clear()
    _SPLIT[w] = out
    return out


def words(text: str) -> list[str]:
    """Words in lower case; numbers are 0, scripts without spaces go by pairs of characters."""
    get = _SPLIT.get
    return [x for w in _WORD.findall(text) for x in get(w) or _parts(w)]


def _h(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) & MASK


_CODES: dict[str, int] = {}


def _code(w: str, kind: str = "w ") -> int:
    key = kind + w
    c = _CODES.get(key)
    if c is None:
        if len(_CODES) > 500_000:
            _CODES.clear()
        c = _CODES[key] = _h(key)
    return c


_MARK = frozenset("⟨0#%")


def _shape(r: str, w: list[str], title: bool) -> list[int]:
    """Features of a unit's shape, each of which counts in full."""
    n = len(w)
    real = [x for x in w if x[0] not in _MARK]
    shape = ["bias", f"n {n if n < 8 else 8 + min(n // 8, 6)}"]
    if n > len(real):
        shape += [f"{'all' if not real else 'some'} {k} {min(len(real) // 6, 2)}" for k in {x for x in w if x[0] == "⟨"}]
    if real:
        shape.append(f"filler {round(4 * sum(x in _FILLER for x in real) / len(real))}")
        if len(real) >= 3:
            shape.append(f"repeat {round(4 * len(set(real)) / len(real))}")
        shape += [f"^ {w[0]}", f"$ {w[-1]}"]
    if title:
        shape.append("title")
    return [_code(x, "") for x in shape]


def _grams(c: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, pairs and triples of a chain of words, and which of them hold a placeholder or status."""
    two = (c[:-1] * 0x9E3779B1 + c[1:] * 0x85EBCA77 + 1) & MASK
    three = (two[:-1] * 0xC2B2AE3D + c[2:] + 2) & MASK
    return np.concatenate([c, two, three]), np.concatenate([special, special[:-1] | special[1:], special[:-2] | special[1:-1] | special[2:]])


def featurize(unit: str, title: bool) -> tuple[np.ndarray, np.ndarray]:
    """Features and their values: n-grams share the weight of one, those with a placeholder or status and the unit's shape count in full."""
    r = reduced(unit)
    w = words(r)
    s = np.array(_shape(r, w, title), dtype=np.int64)
    if not w:
        return s, np.ones(len(s), dtype=np.float32)
    grams, full = _grams(np.array([_code(x) for x in w], dtype=np.int64), np.array([x[0] == "⟨" for x in w]))
    value = np.where(full, 1.0, 1.0 / np.sqrt(max(1, (~full).sum()))).astype(np.float32)
    return np.concatenate([grams, s]), np.concatenate([value, np.ones(len(s), dtype=np.float32)])


def weak_label(unit: str) -> int:
    """1 residue, 0 none."""
    r = reduced(unit)
    low = r.lower()
    about = bool(_ABOUT.search(r))
    w = words(r)
    real = [x for x in w if x[0] not in "⟨0#%"]
    marks = any(x in low for x in ("⟨template⟩", "⟨null⟩", "⟨brace⟩", "⟨request⟩"))
    bracket = "⟨bracket⟩" in low
    if marks:
        return 0 if about and len(real) >= 5 else 1
    if bracket:
        return 1 if not real else 0
    if real and sum(x in _FILLER for x in real) >= 0.6 * len(real):
        return 1
    if len(real) >= 3 and len(set(real)) <= 0.5 * len(real) and len(set(real)) <= 2:
        return 1
    if _NOTICE.search(low):
        return 0 if about and len(real) >= 6 else 1
    if "⟨status⟩" in low and len(w) <= 14 and (_STATUS_FIRST.search(low.strip()) or (_STATUS_NAMED.search(low) and not about)):
        return 1
    return 0


@dataclass
class Model:
    weights: np.ndarray
    report: dict[str, dict[str, float]] = field(default_factory=dict)

    def dump(self) -> tuple:
        rows = np.flatnonzero(np.abs(self.weights) > 1e-4)
        return rows, self.weights[rows]

    @staticmethod
    def load(v: tuple) -> Model:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[v[0]] = v[1]
        return Model(w)

    def probabilities(self, found: list[tuple[str, bool]]) -> np.ndarray:
        """Of each unit the probability to be residue; n-grams of all units are made and weighed at once."""
        shapes, shape_owner, codes, marks, owner = [], [], [], [], []
        for k, (u, t) in enumerate(found):
            r = reduced(u)
            w = words(r)
            s = _shape(r, w, t)
            shapes += s
            shape_owner += [k] * len(s)
            codes += [_code(x) for x in w]
            marks += [x[0] == "⟨" for x in w] if "⟨" in r else [False] * len(w)
            owner += [k] * len(w)
        n = len(found)
        z = np.bincount(np.array(shape_owner, dtype=np.int64), weights=self.weights[np.array(shapes, dtype=np.int64)], minlength=n)
        if codes:
            o = np.array(owner, dtype=np.int64)
            grams, full = _grams(np.array(codes, dtype=np.int64), np.array(marks, dtype=bool))
            # Pairs and triples that reach into the next unit are none.
            last = np.concatenate([o, o[1:], o[2:]])
            own = np.concatenate([np.ones(len(o), bool), o[1:] == o[:-1], o[2:] == o[:-2]])
            v = self.weights[grams]
            rest = own & ~full
            z += np.bincount(last[own & full], weights=v[own & full], minlength=n)
            z += np.bincount(last[rest], weights=v[rest], minlength=n) / np.sqrt(np.maximum(1, np.bincount(last[rest], minlength=n)))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def residue(self, rows: list[tuple[str | None, str | None]]) -> list[float]:
        """Of each (content, html) the highest probability of its units; 0 without any. A unit is weighed once a batch."""
        each = units_of(rows)
        number: dict[tuple[str, bool], int] = {}
        at = [[number.setdefault(u, len(number)) for u in x] for x in each]
        p = self.probabilities(list(number))
        return [float(p[x].max()) if x else 0.0 for x in at]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, epochs: int = 8, rate: float = 0.4, l2: float = 2e-5, seed: int = 5) -> np.ndarray:
    """Logistic regression with an L2 penalty on hashed features, by AdaGrad."""
    w, square = np.zeros(1 << BITS, dtype=np.float32), np.full(1 << BITS, 1e-2, dtype=np.float32)
    rng = np.random.default_rng(seed)
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            size = np.array([len(rows[i][0]) for i in part])
            flat = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), size)
            z = np.bincount(owner, weights=w[flat] * value, minlength=len(part))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * weight[part]
            ids, back = np.unique(flat, return_inverse=True)
            total = np.bincount(back, weights=g[owner] * value).astype(np.float32) + l2 * len(part) * w[ids]
            square[ids] += total**2
            w[ids] -= rate * total / np.sqrt(square[ids])
    return w


def family_of(unit: str) -> int:
    """The family of the phrase or placeholder that a weak label goes by, from 1; 0: none of them."""
    low = reduced(unit).lower()
    if m := _NOTICE.search(low):
        return 1 + next(i for i, line in enumerate(NOTICES.split("\n")) if m.group() in line.split("|"))
    if m := _TEMPLATE.search(unit):
        return 20 + next((i for i, f in enumerate(BRACKETS.values()) if any(m.group().startswith(o.strip()) for o, _ in f)), len(BRACKETS))
    return 0


def held_out(family: int) -> bool:
    return family > 0 and family % 3 == 0


def train(sample: list[tuple[str, str | None, str | None]], phrases: bool = False) -> Model:
    """A model from (job, content, html) of sampled regions and the fixed sentences; jobs of a digest divisible by five only validate. phrases: a third of the families of phrases and placeholders only validate, too."""
    rng = np.random.default_rng(9)
    rows, labels, weight = [], [], []
    held: dict[str, list[tuple[tuple[np.ndarray, np.ndarray], int]]] = {"jobs": [], "phrases": []}

    def add(u: str, t: bool, y: int, w: float) -> None:
        rows.append(featurize(u, t))
        labels.append(y)
        weight.append(w)

    families = [f for i, f in enumerate(BRACKETS.values()) if not (phrases and held_out(20 + i))]

    def mark() -> str:
        k = int(rng.integers(5))
        if k == 0:
            return str(rng.choice(EMPTY))
        if k == 1:
            return str(rng.choice(REQUESTS))
        f = families[int(rng.integers(len(families)))]
        a, b = f[int(rng.integers(len(f)))]
        return a + str(rng.choice(NAMES if a not in ("%", "$") else [n for n in NAMES if n.isupper()])) + b

    for k, line in enumerate(RESIDUE.split("\n")):
        for u in line.split("|"):
            if phrases and (held_out(k + 1) or held_out(family_of(u))):
                held["phrases"].append((featurize(u, False), 1))
            else:
                add(u, False, 1, 5.0)
    for line in ABOUT.split("\n"):
        for u in line.split("|"):
            add(u, False, 0, 5.0)
    for line in FRAMES.split("\n"):
        for f in line.split("|"):
            for _ in range(8):
                add(f.format(mark()), False, 0, 2.0)
    plain: list[str] = []
    # Equal units are one row, which weighs more the more often it stands in the sample.
    often: dict[tuple[str, bool], int] = {}
    each: list[tuple[str, str, bool]] = []
    for (job, _, _), found in zip(sample, units_of([(c, h) for _, c, h in sample]), strict=True):
        for u, t in found:
            k = (re.sub(r"\d+", "0", u), t)
            often[k] = often.get(k, 0) + 1
            if often[k] == 1:
                each.append((job, u, t))
    for job, u, t in each:
        test = xxhash.xxh3_64_intdigest(job or "") % 5 == 0
        y = weak_label(u)
        if phrases and y and held_out(family_of(u)):
            held["phrases"].append((featurize(u, t), 1))
        elif test and often[re.sub(r"\d+", "0", u), t] == 1:
            held["jobs"].append((featurize(u, t), y))
            if not y:
                held["phrases"].append(held["jobs"][-1])
        else:
            add(u, t, y, 1.0 + float(np.log(often[re.sub(r"\d+", "0", u), t])))
            if not y:
                plain.append(u)
    # Placeholders are put in the place of words of ordinary sentences, as such residue comes about; numbers that happen to be statuses make none.
    long = [u for u in plain if len(u) > 20 and not _ABOUT.search(u)]
    for i in rng.permutation(len(long))[:AUGMENTED].tolist():
        parts = long[i].split(" ") if " " in long[i] else [long[i][: len(long[i]) // 2], "", long[i][len(long[i]) // 2 :]]
        at = int(rng.integers(len(parts)))
        add(" ".join([*parts[:at], mark(), *parts[at + 1 :]]), False, 1, 1.0)
    numbered = [u for u in plain if re.search(r"\d", u)]
    for i in rng.permutation(len(numbered))[:AUGMENTED].tolist():
        code = str(rng.choice([400, 401, 403, 404, 405, 410, 429, 500, 502, 503, 504, 417, 406]))
        u = re.sub(r"\d+", code, numbered[i], count=1)
        if weak_label(u) == 0:
            add(u, False, 0, 1.0)
    m = Model(fit(rows, np.array(labels, dtype=np.float32), np.array(weight, dtype=np.float32)))
    for kind, h in held.items():
        if any(v for _, v in h) or kind == "jobs" and h:
            p = np.array([m.weights[f] @ v > 0 for (f, v), _ in h])
            t = np.array([bool(v) for _, v in h])
            m.report[kind] = {"units": len(h), "residue": int(t.sum()), "accuracy": float((p == t).mean()), "recall": float(p[t].mean()) if t.any() else 1.0, "precision": float(t[p].mean()) if p.any() else 1.0}
    return m


def report(regions: DataFrame, most: int = TRAIN_REGIONS) -> DataFrame:
    """(held, units, residue, recall, precision): how the model does on units of jobs, and of families of phrases and placeholders, that it was not fitted on; the labels are the weak ones and the fixed sentences'."""
    sample = sampled(regions, most)
    models = [train(sample), train(sample, phrases=True)] if sample else []
    rows = [(k, m.report[k]["units"], m.report[k]["residue"], round(m.report[k]["recall"], 4), round(m.report[k]["precision"], 4)) for k, m in zip(("jobs", "phrases"), models) if k in m.report]
    return regions.sparkSession.createDataFrame(rows, "held string, units int, residue int, recall double, precision double")


def sampled(regions: DataFrame, most: int) -> list[tuple[str, str | None, str | None]]:
    rows = bounded_sample(regions.where("content IS NOT NULL OR html IS NOT NULL").select("region_id", "job_id", "content", "html"), "region_id", most)
    return [(r["job_id"], r["content"], r["html"]) for r in sorted(rows.collect(), key=lambda r: (r["h"], r["content"] or ""))]


def fitted(regions: DataFrame, most: int = TRAIN_REGIONS) -> Model:
    """The model fitted on a bounded sample of the regions that have content or html."""
    return train(sampled(regions, most))


def residue_scores(regions: DataFrame, model: Model) -> DataFrame:
    """(region_id, score): the score of every row with content or html; equal rows give equal rows."""
    shared = Shared(regions.sparkSession, model.dump(), Model.load)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.get()
        rows = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        scores = [p for i in range(0, len(rows), 2000) for p in m.residue(rows[i : i + 2000])]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["region_id", "score"])

    wanted = regions.where("region_id IS NOT NULL AND (content IS NOT NULL OR html IS NOT NULL)").select(F.col("region_id").cast("bigint"), "content", "html")
    return map_arrow(wanted, run, "region_id bigint, score double")
