"""Forms of personal data that the patterns must take whole."""

from siltstone.llm.pii import _candidates


def test_phone_with_blanks_only(spark):
    text = "call (415) 555 2671 or phone 415 555 2672 now"
    found = _candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().c
    assert {text[c.lo : c.hi] for c in found if c.kind == 3} == {"(415) 555 2671", "415 555 2672"}


def test_long_secret_and_local_part_are_whole(spark):
    secret, mail = "token=" + "aB3" * 100, "x" * 80 + " (at) mail [dot] com"
    text = f"{secret} and {mail} here"
    found = _candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().c
    assert {secret, mail} <= {text[c.lo : c.hi] for c in found}


def test_a_text_with_very_many_spans(spark):
    """Each repetition of a passage has the same spans, and no added span meets a base one."""
    from siltstone.llm.pii import find_personal_data

    unit = "mail jane (at) mail [dot] org or a@b.co, call +1 415-555-2671 or (415) 555-2671, SSN 219-09-9999; "
    n = 3000
    got = find_personal_data(spark.createDataFrame([(1, unit * n), (2, unit)], "doc_id long, text string")).orderBy("doc_id").collect()
    base = sorted((s.lo, s.hi) for s in got[0].base)
    assert len(base) == 2 * n and base == sorted((s.lo + k * len(unit), s.hi + k * len(unit)) for s in got[1].base for k in range(n))
    added = sorted({(s.lo, s.hi) for s in got[0].spans} - set(base))
    assert added == sorted((s.lo + k * len(unit), s.hi + k * len(unit)) for s in got[1].spans if s not in got[1].base for k in range(n)) and len(added) >= 3 * n
    at = 0
    for lo, hi in added:
        while at < len(base) and base[at][1] <= lo:
            at += 1
        assert at == len(base) or base[at][0] >= hi
