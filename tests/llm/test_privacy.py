import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import privacy as V

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return [
        [m.span() for m in EMAIL.finditer(t)],
        [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))],
        [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15],
    ]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("ab@.-1é +", max_size=40), st.text("0129. -+()", max_size=60), st.lists(st.sampled_from(["4111 1111 1111 1111", "a@b.cc", "@", "10.0.0.256", "1.2.3.4", ".5", "+49 (30) 123456", "x", " ", "00", "é"]), max_size=8).map("".join)))
def test_patterns(t):
    assert V.base_spans(t) == brute(t)


def test_long_texts_are_fast():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "1 " * 100_000):
        V.base_spans(t)


def test_documents(docs, awkward):
    rows = awkward + [(50, "mail A.b@c.de, call +49 30 1234567 or 10.1.2.3; card 4111-1111-1111-1111. é x@y.zz")]
    got = V.digest(V.found_spans(docs(rows))).collect()
    want = []
    for r in rows:
        s = brute(r[1] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, found in zip(V.KINDS, s) for a, b in found)
        want.append((str(r[0]), *map(len, s), hashlib.sha256(text.encode()).hexdigest(), text))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got) == sorted(want)


def fill(i):
    return " ".join(f"{chr(97 + i % 26)}{chr(97 + k % 26)}{chr(97 + i * k % 26)}lo" for k in range(12))


def test_terms_that_give_an_entity_away(docs):
    """A nickname that stands by one address in several contexts, and hardly
    anywhere else, goes; common words and copies of one context stay."""
    rows = [(i, f"{fill(i)} the zorbo wrote boss@corp.example about the {fill(i + 40)}") for i in range(5)]
    rows += [(100 + i, f"{fill(i)} the usual {fill(i + 7)}") for i in range(60)]
    rows += [(200 + i, "one copied sentence with solitary@mail.example and nothing else here") for i in range(6)]
    d = docs(rows)
    found = {r.doc_id: r.spans for r in V.digest(V.found_spans(d)).collect()}
    for i, t, *_ in rows:
        words = [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i].split(",") if s) if k == "term"]
        assert ("zorbo" in words) == (i < 5) and "the" not in words and "copied" not in words
    assert found == {r.doc_id: r.spans for r in V.digest(V.found_spans(d, limit=0)).collect()}
    clean = {r.doc_id: r for r in V.sanitised(d).collect()}
    assert "[TERM]" in clean[0].text and "[EMAIL]" in clean[0].text and "zorbo" not in clean[0].text and clean[100].text == rows[5][1]
    assert V.sanitised(d).columns == d.columns


def test_entities_of_one_context_count(docs):
    """In a corpus large enough, a word seen once reveals the address it stands
    by, also if that is mentioned once or twice; common words stay."""
    rows = [(i, f"the {chr(97 + i % 26) * 3} one {fill(i)} text{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}u") for i in range(400)]
    rows += [(1000, "the zorbo one wrote once@corp.example about the"), (1001, "one quibb saw twice@corp.example one"), (1002, "the quibb met twice@corp.example the")]
    d = docs(rows)
    found = {r.doc_id: r.spans for r in V.digest(V.found_spans(d)).collect()}
    words = {i: [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in found[i].split(",") if s) if k == "term"] for i, t in rows}
    assert "zorbo" in words[1000] and "quibb" in words[1001] and "quibb" in words[1002]
    assert not {"the", "one"} & {w for found in words.values() for w in found}
    assert found == {r.doc_id: r.spans for r in V.digest(V.found_spans(d, limit=0)).collect()}


def test_copies_change_nothing(docs):
    """Terms that go from a corpus go as well if one of its texts is copied."""
    rows = [(i, f"the {chr(97 + i % 26) * 3} one {fill(i)} text{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}u") for i in range(400)]
    own = [(1000 + i, f"one {fill(i)} the zorbo wrote boss@corp.example about {fill(i + 9)}") for i in range(3)]
    want = {r.doc_id: r.spans for r in V.digest(V.found_spans(docs(rows + own))).collect()}
    assert "term" in want[1000]
    d = docs(rows + own + [(2000 + i, own[0][1]) for i in range(100)])
    for how in ({}, {"limit": 0}):
        got = {r.doc_id: r.spans for r in V.digest(V.found_spans(d, **how)).collect()}
        assert all(got[i] == want[1000 if i >= 2000 else i] for i in got)


def revealing(rows):
    """The terms to remove by text, from sets of texts."""
    texts = {t or "" for _, t, *_ in rows}
    has = {t: {w.lower() for w in V._TERM.findall(t)} for t in texts}
    near, mention = {}, {}
    for t in texts:
        spans = V.base_spans(t)
        words = V.terms(t, spans)
        for kind, found in enumerate(spans):
            for a, b in found:
                e = (kind, V.normal(kind, t[a:b]))
                mention.setdefault(e, set()).add(t)
                before = [w for w in words if w[0] < a][-V.NEAR :]
                after = [w for w in words if w[0] >= a][: V.NEAR]
                for *_, w in before + after:
                    near.setdefault((e, w), set()).add(t)
    n = len(texts)
    out = {t: set() for t in texts}
    for (e, w), where in near.items():
        spread = max(len(where), sum(w in h for h in has.values())) + V.SMOOTH
        pmi = math.log2(len(where) * n / (spread * len(mention[e])))
        content = math.log2(n / len(mention[e]))
        if content > 0 and pmi >= V.DISCLOSURE * content:
            for t in mention[e]:
                out[t].add(w)
    return out


def test_terms_against_sets(docs):
    """Term spans of a random corpus, with copies, against plain counting."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(900)] + ["İstanbul", "ÉCOLE", "straße"]
    people = [f"p{i}@mail.example" for i in range(12)]
    rows = []
    for i in range(500):
        w = rng.choices(words, k=rng.randint(5, 30))
        for p in rng.sample(people, rng.choice([0, 0, 1, 2])):
            w.insert(rng.randint(0, len(w)), p)
            if rng.random() < 0.7:
                w.insert(w.index(p), f"alias{people.index(p):x}qq".translate(str.maketrans("0123456789", "ghijklmnop")))
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]
    want = revealing(rows)
    assert 0 < sum(map(len, want.values()))
    got = {r.doc_id: r.spans for r in V.digest(V.found_spans(docs(rows))).collect()}
    for i, t in rows:
        have = [(int(a), int(b)) for k, a, b in (s.split(":") for s in got[i].split(",") if s) if k == "term"]
        assert have == [(a, b) for a, b, w in V.terms(t, V.base_spans(t)) if w in want[t]], t


def test_null_stays_null(docs):
    assert {r.doc_id: r.text for r in V.sanitised(docs([(1, None), (2, ""), (3, "a@b.cd")])).collect()} == {1: None, 2: "", 3: "[EMAIL]"}
    assert V.digest(V.found_spans(docs([]))).count() == 0
