"""What must hold of queries that no SQL expresses."""

import re

from siltstone.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, _ = catalog.load()


def by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_each_turn_is_told_once_and_ends_once(spark):
    turns = by(QUERIES["answer_events"](spark, DATA).collect(), "query_id")
    assert turns
    for own in turns.values():
        own.sort(key=lambda r: r.seq)
        names = [r.event for r in own]
        assert [r.seq for r in own] == list(range(len(own)))
        assert names[-1] in ("done", "error") and sum(n in ("done", "error") for n in names) == 1
        assert names[:2] == ["routing", "citation"] and set(names[2:-1]) <= {"token"} or names == ["error"]
        assert all(r.data.startswith("{") for r in own)


def test_chunks_are_parts_of_their_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    chunks = by(QUERIES["chunk_documents"](spark, DATA).collect(), "doc_id")
    assert set(chunks) == {i for i, t in texts.items() if t and t.strip()}
    for i, own in chunks.items():
        own.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in own] == list(range(len(own))) and {r.total_chunks for r in own} == {len(own)}
        assert all(0 < len(r.page_content) <= 1000 and r.page_content in texts[i] for r in own)
        held = re.sub(r"\s", "", "".join(r.page_content for r in own))
        assert len(held) >= len(re.sub(r"\s", "", texts[i]))  # nothing is lost; overlaps come again


def test_markdown_says_nothing_of_its_own(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = QUERIES["html_to_markdown"](spark, DATA).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        assert r.n_chars == len(r.markdown) and "<script" not in r.markdown
        plain = re.sub(r"&\w+;|&#\d+;", " ", pages[r.page_id])
        assert set(re.findall(r"[^\W\d_]{3,}", r.markdown)) <= set(re.findall(r"[^\W\d_]{3,}", plain))
