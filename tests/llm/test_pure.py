"""The text operators without Spark: rules, brute force, round trips, held-out sentences."""

import os
import random

import numpy as np
import pytest

from pagesmith.llm.crf import Chain
from pagesmith.llm import abuse, language, leaks, residue, scans, sentences, tokens, visual


def cut(text):
    return [text[a:b] for a, b in sentences.spans([text])[0]]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Orr sent it to Messrs. Hale & Co. for review. It is No. 50. The end.", 3),
        ("He left at 5 p.m. The door was shut.", 2),
        ("It closes at 6 p.m. and opens at 8 a.m. on Mondays.", 1),
        ('P. U. Hale wrote: "It is lost. Send it again." The clerk read it.', 2),
        ('"Is it genuine?" asked Hale at the counter.', 1),
        ("(The list was made in 1958.) The work was lent.", 2),
        ("Am 3. Dezember fehlte er ... noch immer. Z. B. hier.", 2),
        ("Report on letters, 1974\nThe letters were read\nby the clerk.", 2),
        ("यह है। वज़न 2.5 कि.ग्रा. है। पृ. सं. 4 पर रु. 5 लाख।", 3),
        ("书记员问：“报告在哪里？”然后关上了窗口。“丢了！”他喊道。附件（见图2。表3除外）有效……请看。", 4),
        ("ネヴェロは「届いた。明日また来る。」と書いた。次です。", 2),
        ("ดร.เมโรบีถามว่า\"อยู่ที่ไหน\"แล้วปิด หากพบต้องคืน", 2),
        ("« Les lettres sont perdues. Revenez. » Le greffier sortit.", 2),
        ("<b>One.</b> <i>Two.</i>", 2),
        ("a", 1), ("", 0), ("  \n", 0), (None, 0), ("no end", 1), ("... !", 1),
    ],
)
def test_sentences(text, want):
    assert len(sentences.spans([text])[0]) == want


def test_tags_stay_with_their_words():
    assert cut("<b>One.</b> <i>Two.</i>") == ["<b>One.</b>", "<i>Two.</i>"]


def test_every_visible_character_is_in_one_sentence():
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("ab A.!?。\n “”\"'()«»…1,<b>​कไ") for _ in range(rng.randint(0, 60)))
        marks = np.zeros(len(t), dtype=int)
        for a, b in sentences.spans([t])[0]:
            assert a < b and not t[a].isspace() and not t[b - 1].isspace()
            marks[a:b] += 1
        assert all(marks[i] == 1 for i, c in enumerate(t) if not c.isspace() and c != "​")


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_prefix_scan_equals_plain_steps(chunk):
    rng = np.random.default_rng(4)
    cls = rng.integers(0, sentences.N_CLASSES, 1000).astype(np.uint8)
    assert (sentences.scan_long(cls, chunk) == sentences._run(cls, 0)[0]).all()


def test_long_texts_are_cut_like_short_ones():
    t = "One thing was said. Another was not! " * 800
    assert len(sentences.spans([t])[0]) == 1600


@pytest.mark.parametrize("a,b,same", [("Ｔhe ﬁle", "The file", True), ("café", "café", True), ("a b", "a b", True), ("a  b", "a b", False), ("Сору", "Copy", True), ("x²", "x2", False), ("Case", "case", False), ("a\nb", "a b", False), ("क‌्र", "क्र", True), ("क्‌र", "क्र", False), ("soft­ly", "softly", True), ("①", "1", False), ("ё", "ё", True), ("", "", True)])
def test_canonical(a, b, same):
    assert (visual.canonical(a) == visual.canonical(b)) is same
    assert visual.canonical(visual.canonical(a)) == visual.canonical(a)


def test_canonical_null():
    assert visual.canonical(None) is None


vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="vocabulary files are missing")


@pytest.fixture(scope="module")
def encoder():
    return tokens.load()


@vocabulary
def test_tokens_equal_the_library(encoder):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(tokens.VOCABULARY)
    ref.encode_special_tokens = True
    rng = random.Random(1)
    for _ in range(1500):
        s = "".join(rng.choice("abtheing  \n'sक्.,é€😀<|endoftext|>123") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(s) == ref.encode(s, add_special_tokens=False).ids
    long = "abcde" * 5000
    assert encoder.encode(long) == ref.encode(long, add_special_tokens=False).ids
    g, cur = tokens.Growing(encoder.vocabulary), ""
    for _ in range(150):
        i = rng.randint(0, len(cur))
        j = min(len(cur), i + rng.randint(0, 4))
        new = "".join(rng.choice("the ing's 1é\n ") for _ in range(rng.randint(0, 6)))
        cur = cur[:i] + new + cur[j:]
        assert g.replace(i, j, new) == ref.encode(cur, add_special_tokens=False).ids


@vocabulary
def test_tokens_of_nothing_and_after_forgetting(encoder):
    ids, n = encoder.encode_batch([None, "", "a b", "a b"])
    assert n.tolist() == [0, 0, 2, 2] and ids[:2].tolist() == ids[2:].tolist()
    encoder.pieces_kept, kept = 1, encoder.pieces_kept
    assert encoder.encode("one two three") == encoder.encode("one two three")
    encoder.pieces_kept = kept


def brute(text, item):
    w = lambda t: ["".join(c for c in x.lower() if c.isalnum()) for x in t.split()]
    a, b = [x for x in w(item) if x], [x for x in w(text) if x]
    need = -(-len(a) // 2)
    for off in range(-len(a), len(b)):
        eq = [0 <= k + off < len(b) and a[k] == b[k + off] for k in range(len(a))]
        for s in range(len(a)):
            for e in range(s + need, len(a) + 1):
                if eq[s] and eq[e - 1] and 0 <= s + off and e + off <= len(b) and sum(not x for x in eq[s:e]) <= (e - s) * 0.1:
                    return True
    return False


def test_leaks_equal_brute_force():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    items = [" ".join(word() for _ in range(rng.choice([50, 61, 80]))) for _ in range(8)]
    texts = []
    for _ in range(250):
        ws = rng.choice(items).split()
        n = rng.randint(len(ws) // 4, len(ws))
        s = rng.randint(0, len(ws) - n)
        part = [word() if rng.random() < rng.choice([0, 0.05, 0.12]) else x for x in ws[s : s + n]]
        body = rng.choice([" ", "\n", ", "]).join(x.upper() if rng.random() < 0.1 else x for x in part)
        texts.append(" ".join(word() for _ in range(9)) + " " + body + " " + " ".join(word() for _ in range(9)))
    found = set(leaks.search(texts, leaks.Items(list(range(8)), items)))
    want = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if brute(t, item)}
    assert 20 < len(want) < 240
    assert found == want


def test_leaks_of_nothing():
    assert leaks.search(["", "x"], leaks.Items([1, 2], ["", "...."])) == []


@pytest.fixture(scope="module")
def lang_model():
    return language.train([])


@pytest.mark.parametrize("text,lang", [("The clerk has written this letter for the office.", "en"), ("Le greffier a écrit cette lettre pour le bureau.", "fr"), ("Der Schreiber hat den Brief für das Amt geschrieben.", "de"), ("El escribano ha escrito la carta para la oficina.", "es"), ("Yeh patra kal daftar mein rakha gaya tha.", "hi"), ("यह पत्र कार्यालय में रखा गया है।", "hi"), ("हे पत्र कार्यालयात आहे आणि ते जुने आहे.", "mr"), ("Lorem ipsum dolor sit amet elit.", None), ("", None), (None, None)])
def test_language(lang_model, text, lang):
    s = lang_model.label([text])[0]
    assert [language.LANGUAGES[x[2]] if x[2] < language.NONE else None for x in s] == ([lang] if text else [])


def test_a_quoted_title_has_no_vote(lang_model):
    s = lang_model.label(['The work "Registre ordinaire des lettres" was lent to the office.'])[0]
    assert language.LANGUAGES[s[0][2]] == "en"


@pytest.fixture(scope="module")
def residue_model():
    rng = random.Random(1)
    noun = "letter form table office record page column map index note".split()
    plain = [f"The {rng.choice(noun)} of {rng.choice(noun)} {i} was read by the clerk in {1900 + i % 90}." for i in range(400)]
    return residue.train([(f"j{i % 50}", t, None) for i, t in enumerate(plain)])


@pytest.mark.parametrize("content,html,hit", [("{{customer_name}}", None, True), ("The letter of note 5 was <%= verb %> by the clerk.", None, True), ("The area follows from {{EQ:0}} once {{EQ:1}} is known.", None, False), (None, "<html><head><title>502</title></head><body><h1>502 Bad Gateway</h1></body></html>", True), (None, "<table><tr><td>404</td><td>12.5</td></tr></table>", False), ("Please enable JavaScript to view this page.", None, True), ("The manual explains that error 404 means a missing sheet in drawer 4.", None, False), ("The letter of office 7 was read by the clerk in 1950.", None, False), (None, None, False), ("", "", False), ("  ", None, False)])
def test_residue(residue_model, content, html, hit):
    assert bool(residue_model.residue([(content, html)])[0] >= 0.5) is hit


@pytest.mark.parametrize("text,hit", [("{$user_name}", True), ("Dear ((CLIENT)), thank you.", True), ("Der Server ist überlastet.", True), ("Coming soon", True), ("The author discusses %NAME% in a footnote on syntax.", False), ("The letter of ((DATE)) was read by the clerk.", True)])
def test_residue_of_other_kinds(residue_model, text, hit):
    assert bool(residue_model.residue([(text, None)])[0] >= 0.5) is hit


def test_units_are_cut_at_ends_and_not_in_placeholders():
    assert residue.cut_block("One. Two! <% a. b %> three\nFour।पाँच।") == ["One.", "Two!", "<% a. b %> three", "Four।", "पाँच।"]


def test_residue_weighs_a_batch_like_single_units(residue_model):
    found = [("${name}", False), ("The letter of office 7.", False), ("404 Not Found", True), ("", False), ("a b ${x} c", False)]
    one = [residue.featurize(u, t) for u, t in found]
    want = [1 / (1 + np.exp(-float(residue_model.weights[f] @ v))) for f, v in one]
    assert np.allclose(residue_model.probabilities(found), want, atol=1e-4)


def test_residue_on_unseen_jobs(residue_model):
    assert residue_model.report["jobs"]["accuracy"] > 0.95


@pytest.fixture(scope="module")
def abuse_model():
    return abuse.train([], [f"The clerk read letter {i} and put it into the table of the office." for i in range(60)])


@pytest.mark.parametrize("text,hit", [("You are a worthless idiot and everybody laughs at you.", True), ("Y0u 4re a w0rthl3ss id1ot and everybody laughs at you.", True), ("You are a w​orthless i​diot and everybody laughs at you.", True), ("闭嘴，你这个白痴，没人想听你说话。", True), ("To stop the scan, kill the process and restart the dumb terminal.", False), ("The clerk read letter 7 and put it into the table.", False), ("", False), (None, False)])
def test_abuse(abuse_model, text, hit):
    score, spans = abuse.score(abuse_model, [text])[0]
    assert (score >= abuse.THRESHOLD) is hit and bool(spans) is hit


@pytest.mark.parametrize("text,hit", [("Fuck you.", True), ("Idiot!", True), ("Du Arschloch!", True), ("The report follows. You idiot. The table is below.", True), ("白痴。", True), ("Thank you.", False), ("You are.", False), ("Du!", False), ("Yes.", False), ("Kill process.", False)])
def test_abuse_in_one_or_two_words(abuse_model, text, hit):
    score, spans = abuse.score(abuse_model, [text])[0]
    assert (score >= abuse.THRESHOLD) is hit and bool(spans) is hit


@pytest.mark.parametrize("a,b", [("k1ll", "kill"), ("hiiiill", "hill"), ("$h0uld", "should"), ("2024", "#"), ("ТЕST", "test")])
def test_plain_form(a, b):
    assert abuse.plain(a) == b


@pytest.mark.parametrize("line,page,hit", [("p. 6", 6, True), ("- 12 -", 12, True), ("xxxvi", 36, True), ("7/10", 7, True), ("7/10", 8, False), ("[9]", 9, True), ("Page 3 of 8", 3, True), ("1953", 5, False), ("iv and more", 4, False), ("", 1, False)])
def test_page_number(line, page, hit):
    assert scans.is_page_number(line, page) is hit


@pytest.mark.parametrize("read,right", [("eommittee", "committee"), ("eritries", "entries"), ("f0und", "found"), ("railvvay", "railway"), ("attacbed", "attached"), ("cornpared", "compared")])
def test_variants(read, right):
    assert right in scans.variants(read)


@pytest.mark.parametrize("tail,head,hit", [("Because it was lost, the", "House compared it.", True), ("It was read.", "The next one.", False), ("It was read by", "them.", True), ("मेरोबी ने बताया कि", "वह नहीं है।", True), ("", "x", False), ("It is a commit-", "tee.", True)])
def test_goes_on(tail, head, hit):
    assert scans.goes_on([(tail, head)]) == [hit]


def test_two_labels_equal_the_plain_chain():
    rng = np.random.default_rng(2)
    c = Chain(2, 8)
    c.edges = rng.normal(size=(2, 2, 2)).astype(np.float32)
    sizes = [1, 2, 5, 9, 9]
    s, edge, mask = rng.normal(size=(5, 9, 2)) * 3, rng.integers(0, 2, (5, 9)), np.arange(9) < np.array(sizes)[:, None]
    p, xi = c.marginals(s, edge, mask, pairs=True)
    want = np.zeros((2, 2, 2))
    for i, n in enumerate(sizes):
        paths = [[int(x) for x in f"{k:0{n}b}"] for k in range(2**n)]
        w = np.array([np.exp(sum(s[i, j, y] for j, y in enumerate(z)) + sum(c.edges[edge[i, j], z[j - 1], z[j]] for j in range(1, n))) for z in paths])
        w /= w.sum()
        assert np.allclose([sum(v for v, z in zip(w, paths) if z[j] == 1) for j in range(n)], p[i, :n, 1], atol=1e-5)
        for v, z in zip(w, paths):
            for j in range(1, n):
                want[edge[i, j], z[j - 1], z[j]] += v
    assert np.allclose(xi, want, atol=1e-4)


def plain_score(model, text):
    """A text's score step by step: one chain over all its tokens, sentence by sentence."""
    found, _ = abuse.tokens(text)
    numbers = [model.number(w) for w in found]
    codes, ends = np.array([model.codes[n] for n in numbers]), [model.ends[n] for n in numbers]
    s = np.zeros((1, len(codes), 2), np.float32)
    s[0, :, 1] = model.lean[abuse.feature_rows(codes)].sum(axis=1)
    edge = np.array([[0, *map(int, ends[:-1])]])
    p = model.chain.marginals(s, edge, np.ones((1, len(codes)), bool))[0][0, :, 1]
    best, now = 0.0, []
    for i in range(len(codes) + 1):
        if i == len(codes) or ends[i]:
            if now:
                q = np.sort(p[now])
                v = max(float(q.mean()), float(q[-4:].mean()) if (q > 0.5).sum() >= 3 else 0.0) if len(now) > 2 else 0.0 if all(abuse.plain(found[k]) in abuse.ADDRESS for k in now) else float(q.min())
                best = max(best, v)
            now = []
        else:
            now.append(i)
    return best


def test_every_text_has_the_score_of_the_plain_chain(abuse_model):
    rng = np.random.default_rng(4)
    pool = ["You idiot!", "Drop dead.", "The clerk read the letter.", "You are.", "Minutes were taken of the meeting and put away", "Fuck you.", "\n", "वह एक कमीना है।", "今日は。", "S h u t u p you pig.", "Sale con !"]
    texts = [" ".join(rng.choice(pool, size=int(rng.integers(1, 9)))) for _ in range(80)] + ["", None, "...", "x"]
    got = abuse.score(abuse_model, texts)
    for t, (v, _) in zip(texts, got, strict=True):
        assert v == pytest.approx(plain_score(abuse_model, t) if t and abuse.tokens(t)[0] else 0.0, abs=1e-5)
    assert min(v for t, (v, _) in zip(texts, got) if t and any(c.isalpha() for c in t) and "You are." not in t) > 0


@pytest.mark.parametrize("n", [12, 60, 150, 400, 1000, 3000])
def test_leaks_whose_replaced_words_drift(n):
    rng = random.Random(n)
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    for _ in range(4):
        item = [word(3, 9) for _ in range(n)]
        close, far = list(item), list(item)
        for k in range(5, n, 11):
            close[k] = item[k] + word(5, 5)
        for k in range(0, n, 5):
            far[k] = word(8, 8)
        around = [word(3, 9) for _ in range(50)]
        one = leaks.Items([7], [" ".join(item)])
        assert leaks.search([" ".join([*around, *close, *around])], one) == [(0, 7)]
        assert leaks.search([" ".join([*around, *far, *around])], one) == []


def test_leaks_of_very_short_words_and_of_repeats():
    short = "a b c d e f g h i j k l m n o p q r s t u v w x y z a c e g"
    assert leaks.search([f"so {short} then"], leaks.Items([1], [short])) == [(0, 1)]
    again = " ".join(["the same words again"] * 200)
    assert leaks.search([f"It says {again}."], leaks.Items([2], [again])) == [(0, 2)]
    mixed = " ".join(["na na na"] * 60 + [f"verse{i}" for i in range(80)])
    assert leaks.search([mixed.upper()], leaks.Items([3], [mixed])) == [(0, 3)]


def test_very_long_words_by_their_skeleton():
    long = "abcdefghijklmnopqrstuvwxyz" * 4
    read = long.replace("m", "rn", 1)
    assert scans.skeleton(read) == scans.skeleton(long) and scans.changes(read, long) == 1
    assert scans.changes(read.replace("w", "vv"), long) == 3 and scans.changes(long, long) == 0 and scans.changes("x" + long, long) == 3
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdehilmnorstuvw0156") for _ in range(rng.randint(3, 9)))
        for v, n in scans.variants(w).items():
            assert scans.skeleton(v) == scans.skeleton(w) and scans.changes(w, v) <= n


def test_characters_beyond_the_first_plane():
    import unicodedata

    for c in ("\U0002f800", "\U0001d15e", "\U000110a1\U000110ba", "\U0001f600"):
        assert visual.canonical(f"a {c} b") == unicodedata.normalize("NFC", f"a {c} b")
    assert cut("It is \U0001f600 good. The end \U0001f600 came.") == ["It is \U0001f600 good.", "The end \U0001f600 came."]
