import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from seqlode.llm import exact_dedup as E


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_against_brute_force(messy):
    groups = defaultdict(list)
    for r in messy.collect():
        groups[fold(r.text)].append(r.doc_id)
    out = E.report(E.exact_dedup(messy)).collect()
    assert len(out) == messy.count()
    kept = defaultdict(int)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in out:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_contents_with_one_digest_stay_apart(messy):
    plain = sorted(map(repr, (r[1:] for r in E.exact_dedup(messy).drop("digest").collect())))
    weak = E.exact_dedup(messy, digest=lambda c: F.lit(b"x"), salts=2)
    assert sorted(map(repr, (r[1:] for r in weak.drop("digest").collect()))) == plain


def test_empty(empty):
    assert E.report(E.exact_dedup(empty)).collect() == []


def test_only_ascii_is_folded(make):
    from .conftest import rows_of

    out = E.exact_dedup(make(rows_of(["É", "é", "K", "K", "k"]))).collect()
    assert sorted(r.group_size for r in out) == [1, 1, 1, 2, 2]
