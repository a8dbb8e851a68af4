import random
import re

import numpy as np

from seqlode.llm import hashing
from seqlode.llm import substring_dedup as S

MARKS = ".!?\u037e؟۔…‼⁇⁈⁉。｡！？．।॥።။።"


def sentences(text):
    """Sentences by their definition, word by word: (start, end, words in lower case). Of the operator only the hash of
    a word is used."""
    words = [(m.start(), m.end(), S._lower(m.group())) for m in re.finditer(r"[^\x00\x09-\x0d\x1c-\x20]+", text)]
    raw = [w.encode() for _, _, w in words]
    edges = np.cumsum([0, *(len(r) for r in raw)])
    order = hashing.segments(np.frombuffer(b"".join(raw), np.uint8), edges[:-1], edges[1:]).tolist() if words else []
    out, since, opened = [], 0, 0

    def least(last):  # place of the least hash among the CUT words up to `last`, of equal ones the last place
        return min(range(last - S.CUT + 1, last + 1), key=lambda i: (order[i], -i))

    for i, (_, end, word) in enumerate(words):
        since += 1
        marked = i + 1 == len(words) or word[-1] in MARKS or "\n" in text[end : words[i + 1][0]]
        if marked or since == S.CUT or (since > S.CUT and least(i) != least(i - 1)):
            stop = words[i + 1][0] if i + 1 < len(words) else len(text)
            out.append((words[opened][0], stop, [w for _, _, w in words[opened : i + 1]]))
            opened = i + 1
        if marked:
            since = 0
    return out


def brute(rows):
    """Texts in the order in which occurrences count."""
    seen, out = set(), []
    for text in rows:
        text = text or ""
        parts, gone, own = sentences(text), set(), []
        for i in range(len(parts)):
            j, key = i, []
            while j < len(parts) and (len(key) < S.MIN_WORDS or j - i < S.SENTENCES):
                key.append(parts[j][2])
                key = [w for x in key for w in (x if isinstance(x, list) else [x])]
                j += 1
            if len(key) >= S.MIN_WORDS and j - i >= S.SENTENCES:
                key = tuple(tuple(p[2]) for p in parts[i:j])
                if key in seen:
                    gone |= set(range(i, j))
                seen.add(key)
        lead = text[: parts[0][0]] if parts else text
        out.append((len(parts), len(gone), lead + "".join(text[a:b] for i, (a, b, _) in enumerate(parts) if i not in gone)))
    return out


def compare(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in S.substring_dedup(docs).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute([t for _, t in rows]), strict=True)}


def test_small(spark):
    compare(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_planted_passages(make):
    from .conftest import rows_of

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", ".", ",", "!", "\n"]) for _ in range(n))
    passage, bare = text(60), " ".join(word() for _ in range(70))
    texts = [text(80) for _ in range(30)]
    for i in (3, 9, 20):
        texts[i] = texts[i][:100] + " " + passage + " " + texts[i][100:]
    for i in (5, 11):
        texts[i] = texts[i] + bare.upper() + " tail"
    docs = make(rows_of(texts))
    compare(docs)
    out = {r.doc_id: r for r in S.substring_dedup(docs).collect()}
    assert {d for d, r in out.items() if r.n_removed} == {9, 20, 11}
    middle = " ".join(passage.split()[25:35])
    assert middle in " ".join(out[3].text.split()) and middle not in " ".join(out[20].text.split())


def test_places_match_the_text(make):
    from .conftest import rows_of

    passage = " ".join(f"Wörter{i} sind İ😀 da{'.' if i % 4 == 0 else ''}" for i in range(40))
    docs = make(rows_of(["Ein Anfang. " + passage, "Anders 😀 hier. " + passage + " Ende."]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    r = {r.doc_id: r for r in S.substring_dedup(docs).collect()}[1]
    kept, at = "", 0
    for place in r.removed.split(","):
        a, b = map(int, place.split(":"))
        kept, at = kept + texts[1][at:a], b
    assert kept + texts[1][at:] == r.text
    assert r.text.startswith("Anders 😀 hier. ") and r.text.endswith("Ende.")


def test_messy(messy, empty):
    """Rows of one id, and null ids, each count by themselves; which of them is first does not change the results as a
    whole."""
    rows = [(r.doc_id is None, r.doc_id or 0, r.text) for r in messy.collect()]
    want = sorted(brute([t for *_, t in sorted(rows, key=lambda r: r[:2])]))
    assert sorted((r.n_sentences, r.n_removed, r.text) for r in S.substring_dedup(messy).collect()) == want
    assert S.substring_dedup(empty).collect() == []


def test_rows_of_one_id(spark):
    """What stands once stays, and of equal rows one stays whole: with equal, repeated, textual and null ids."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) + rng.choice(["", ".", ""]) for _ in range(200))
    a, b = text(), text()
    for kind, ids in (("long", [1, 5, 5, 5]), ("string", ["a", "b", "b", "b"]), ("long", [None] * 4), ("string", [None] * 4)):
        for parts in (1, 3):
            docs = spark.createDataFrame(list(zip(ids, [a, a, b, a])), f"doc_id {kind}, text string").repartition(parts)
            out = S.substring_dedup(docs).collect()
            assert sorted((r.n_removed > 0, r.text) for r in out) == sorted([(False, a), (False, b), (True, ""), (True, "")])
            assert sorted(map(str, (r.doc_id for r in out))) == sorted(map(str, ids))
            if ids[0] is not None:
                assert [r.doc_id for r in out if r.text == a] == [ids[0]]


def test_nulls(make):
    from .conftest import rows_of

    text = " ".join(f"word{i}." for i in range(40))
    rows = [*rows_of([text, None]), (None, text, *([None] * 8))]
    out = {r.doc_id: r for r in S.substring_dedup(make(rows)).collect()}
    assert (out[0].n_removed, out[1].text, out[None].n_removed) == (0, "", 40)


def test_every_passage_of_50_words_is_found(make):
    """Words without marks, in the middle of a sentence of either host."""
    from .conftest import rows_of

    rng = random.Random(51)
    words = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    passages = [words(rng.randint(50, 60)) for _ in range(300)]
    first = [f"{words(rng.randint(0, 40))} {p} {words(rng.randint(0, 40))}" for p in passages]
    again = [f"{words(rng.randint(0, 40))} {p} {words(rng.randint(0, 40))}" for p in passages]
    docs = make(rows_of(first + again))
    out = {r.doc_id: r for r in S.substring_dedup(docs).collect()}
    assert [d for d in range(300) if out[d].n_removed] == []
    assert [d for d in range(300, 600) if not out[d].n_removed] == []
    for d, p in enumerate(passages, 300):
        gone = len(again[d - 300].split()) - len(out[d].text.split())
        assert S.MIN_WORDS <= gone <= len(p.split())
    compare(docs)


def test_sentences_are_short_and_end_at_marks():
    rng = random.Random(3)
    text = " ".join(rng.choice(["la", "le", "lu"]) for _ in range(400)) + " " + " ".join(str(rng.random()) for _ in range(400))
    assert S._pieces([text])[2].max() <= S.CUT
    for mark in ".!?…。！？؟।":
        _, _, count, begin, _ = S._pieces([f"drei é Wörter{mark} und zwei"])
        assert count.tolist() == [3, 2] and begin[1] == len(f"drei é Wörter{mark} ")
