import re
from collections import Counter

from tests.llm.fixtures import ROWS, clashing, docs, empty
from tidemark.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_exclaims": t.count("!"), "n_capitals": len(re.findall("[A-Z]", t)), "n_letters": len(re.findall("[A-Za-z]", t)),
        "n_bullet_lines": sum(bool(re.match("[\x20\x09-\x0d]*[-*•]", x)) for x in lines),
    }


MORE = [
    (20, "a b c d a b c e", "en", "a", 0),
    (21, "a a a a a", "en", "a", 0),
    (22, "a b c x a b c y a b c", "en", "a", 0),
    (23, "- one\n* two\n• three\n  nbsp is a word\n", "en", "a", 0),
    (24, "#tag $5 <b> ### SHOUT!! SHOUT!! ok", "en", "a", 0),
    (25, "x\r\nx\r\n\n\x0b\x0c", "en", "a", 0),
]


def test_measures_against_brute_force(spark):
    rows = [*ROWS, *MORE]
    got = quality.measured(docs(spark, rows).withColumnRenamed("source", "raw").selectExpr("*", "text AS original")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {k: r[k] for k in quality.MEASURES} == brute(r.original), r.doc_id


def test_policies_and_ablations_come_from_stored_bits(spark):
    book = quality.ledger(docs(spark, [*ROWS, *MORE])).select("doc_id", "failures")
    rows = book.collect()
    for version, names in quality.POLICIES.items():
        mask = quality.policy_mask(names)
        kept = {(r.doc_id, r.failures): r.kept for r in quality.apply_policy(book, version).collect()}
        assert all(k == (f & mask == 0) for (_, f), k in kept.items())
        bits = {r.name: 1 << r.bit for r in quality.RULES}
        for r in quality.ablations(book, version).collect():
            assert r.n_failed == sum(bool(x.failures & bits[r.rule]) for x in rows)
            assert r.n_only == sum(x.failures & mask == bits[r.rule] for x in rows)


def test_empty_and_clashing(spark):
    assert quality.ledger(empty(spark)).count() == 0
    names = ("_words", "_lines", "_starts", "n_words", "failures", "kept", "h", "i")
    got = quality.apply_policy(quality.ledger(clashing(spark, *names)))
    assert {r._words for r in got.select("_words").collect()} == {7}
    assert got.where("n_words = 7").count() == 1 and got.schema["kept"].dataType.simpleString() == "boolean"


def test_bits_are_fixed():
    assert [r.bit for r in quality.RULES] == list(range(len(quality.RULES)))
