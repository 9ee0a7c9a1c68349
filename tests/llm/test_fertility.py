import math
import re
from collections import Counter

import numpy as np

from docloom.llm import fertility as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, twice = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), twice, len(covered)


EXTRA = ["a\nb\na\n \n \nb\r\nb", "x # y <z>\n\n\nx # y <z>", "a b c a b c a", "é é é é", "\n", "a b a b a b", "日本語 テキスト " * 40]


def test_base_statistics(docs, awkward):
    rows = awkward + [(60 + i, t) for i, t in enumerate(EXTRA)]
    got = T.judged(docs(rows)).collect()
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    want = []
    for r in rows:
        b = brute(r[1])
        want.append((str(r[0]), *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert have == sorted(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_measures_against_plain_counting():
    paths = tuple(map(T.vocabulary, T.VOCABULARIES))
    texts = ["hello world, hello!", "", "日本 é", "a"]
    got = T.token_measures(texts, paths)
    for t, row in zip(texts, got):
        ids = T.encoder(paths[0])(t)
        if not ids:
            assert np.isnan(row).all()
            continue
        n = Counter(ids)
        h = -sum(c / len(ids) * np.log2(c / len(ids)) for c in n.values())
        assert np.allclose(row[[0, 3]], [len(t) / len(ids), h / max(1, np.log2(max(2, len(ids))))])
        assert np.isclose(row[2], sum(T.fallback_ids(paths[0])[i] for i in ids) / len(ids))
    assert got[2, 2] > 0 and got[0, 2] == 0


def test_bands_reject_what_the_language_never_does(spark, docs):
    rng = np.random.default_rng(0)
    vocab = ["time", "people", "water", "house", "light", "under", "never", "world", "three", "small"]
    rows = [(i, " ".join(rng.choice(vocab, 80)), "en", "s") for i in range(120)]
    odd = [(1000, " ".join("".join(rng.choice(list("qxzjkvw0123#"), 8)) for _ in range(80)), "en", "s"), (1001, "ü€ŋ😀" * 3 + " " + " ".join(f"ŋ€{i}ß" for i in range(80)), "en", "s")]
    rows += [(2000, rows[0][1], None, "s"), (2001, rows[1][1], "xx", "s")]
    got = {r.doc_id: r for r in T.judged(docs([*rows, *odd])).collect()}
    assert not got[1000].kept and not got[1001].kept
    assert all(r.kept for i, r in got.items() if not 1000 <= i <= 1001 and not r.base_failed)


WORDS = "time people water house light under never world three small about after again could every first found great large might other place right still their think where which write years being below earth given group heard human known later leave local means money month music night order paper party peace point power press price quite river round short since south sound".split()


def de_bruijn(words):
    """Every three of ``words`` once: none repeats, though there are few."""
    seen, out = set(), [words[0]] * 2
    while True:
        new = next((w for w in reversed(words) if (*out[-2:], w) not in seen), None)
        if new is None:
            return " ".join(out)
        seen.add((*out[-2:], new))
        out.append(new)


def test_low_entropy_is_rejected(docs):
    """Also among texts of many lengths, where the entropies spread."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS, n)), "en", "s") for i, n in enumerate(np.geomspace(60, 600, 150).astype(int).tolist())]
    got = {r.doc_id: r for r in T.judged(docs([*rows, (1000, de_bruijn(WORDS[:4]), "en", "s")])).collect()}
    assert not got[1000].base_failed and not got[1000].kept
    assert all(r.kept for i, r in got.items() if i < 1000)


def test_small_languages_have_bands_of_their_own(docs):
    """Junk in a language of 20 texts is rejected as it would be in one of 50,
    and a rare script isn't judged by another one."""
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS, 80)), "en", "s") for i in range(120)]
    other = [w[::-1].replace("e", "ü") for w in WORDS]
    junk = " ".join("".join(rng.choice(list("qxzjkvw0123#"), 8)) for _ in range(80))
    for n in (20, 49, 50):
        small = [(1000 + i, " ".join(rng.choice(other, 80)), "xx", "s") for i in range(n)]
        korean = [(2000, " ".join(chr(0xAC00 + int(x)) * 2 + chr(0xAC00 + i) for i, x in enumerate(rng.integers(0, 9000, 80))), "ko", "s")]
        got = {r.doc_id: r for r in T.judged(docs([*rows, *small, *korean, (3000, junk, "xx", "s")])).collect()}
        assert not got[3000].base_failed and not got[3000].kept, n
        assert got[2000].fallback_share > 0.5 and all(r.kept for i, r in got.items() if i < 3000), n


def brute_kept(rows, found):
    """``kept`` from the measures, by sorting."""
    at = lambda v, p: sorted(v)[math.ceil(p * len(v)) - 1]
    grid = lambda x: math.floor(x * T.GRID + 0.5) / T.GRID
    good = [r for r in rows if not r["failed"]]
    three = lambda rs, c: np.array([at([grid(r[c]) for r in rs], p) for p in (0.25, 0.5, 0.75)])
    langs = {}
    for r in good:
        langs.setdefault(r["lang"], []).append(r)
    script = {k: min(((-sum(r["script"] == s for r in rs), s) for s in {r["script"] for r in rs}))[1] for k, rs in langs.items()}
    band = {}
    for k, rs in langs.items():
        alike = [x for x in langs if script[x] == script[k]]
        for c, reach, floor in zip(T.MEASURES, T.REACH, T.FLOOR):
            q, whole = three(rs, c), three([r for r in good if r["script"] == script[k]], c)
            mean = sum(len(langs[x]) * np.diff(three(langs[x], c)) for x in alike) / sum(len(langs[x]) for x in alike)
            down, up = (len(rs) * np.diff(q) + T.LEAST * mean) / (len(rs) + T.LEAST)
            mid = (len(rs) * q[1] + whole[1]) / (len(rs) + 1)
            wide = reach * (down + up + (whole[2] - whole[0]) / (len(rs) + 1))
            low, high = min(mid - down - wide, mid - floor), max(mid + up + wide, mid + floor)
            if c == "token_entropy":
                low, high = max(low, (mid - down) / 2), min(high, (9 + mid + up) / 10)
            band[k, c] = low, high
    return {r["id"]: not r["failed"] and all(band[r["lang"], c][0] <= r[c] <= band[r["lang"], c][1] for c in T.MEASURES) for r in rows}


def test_verdicts_against_sorting(docs):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        words = WORDS if i % 2 else [w[::-1] + "é" for w in WORDS]
        pick = rng.choice(words[: rng.integers(40, len(words))], rng.integers(40, 200))
        text = " ".join("".join(rng.choice(list("qxzjkvw0123#"), 8)) if rng.random() < (i % 23 == 0) else w for w in pick)
        rows.append((i, text, "en" if i % 2 else ["fr", "de"][i % 3 == 0], "s"))
    found = T.token_measures([t for _, t, *_ in rows], tuple(map(T.vocabulary, T.VOCABULARIES)))
    got = {r.doc_id: r for r in T.judged(docs(rows)).collect()}
    plain = [{"id": i, "lang": lang, "script": T.script(t), "failed": got[i].base_failed, **dict(zip(T.MEASURES, m))} for (i, t, lang, _), m in zip(rows, found)]
    want = brute_kept(plain, found)
    assert {i: r.kept for i, r in got.items()} == want and 0 < sum(want.values()) < sum(not r.base_failed for r in got.values())


def test_without_a_language_column(docs, awkward):
    d = docs(awkward).drop("lang")
    got = T.judged(d).collect()
    assert len(got) == len(awkward) and not any(r.kept for r in got if r.n_words == 0)


def test_script_and_empty(docs):
    assert (T.script("abc"), T.script("日本語の"), T.script("12")) == ("script 0", "script 48", "script none") or T.script("日本語の").startswith("script ")
    assert T.judged(docs([])).count() == 0
