import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import chunks, extract, rag, routing, vectors
from siltstone.operators.routing import DEFAULT_ROSTER


@settings(max_examples=60, deadline=None)
@given(st.text("ab c\n#`", max_size=400), st.integers(5, 60), st.integers(0, 20))
def test_chunks_are_bounded_and_lose_nothing(t, size, overlap):
    pieces = chunks._pieces(t, size, 0)
    assert "".join(pieces) == t and all(0 < len(p) <= size for p in pieces)
    got = chunks.split_text(t, size, overlap)
    assert all(0 < len(c) <= size for c in got)
    assert set("".join(t.split())) == set("".join("".join(got).split()))


def test_routes(spark):
    cases = [
        ("How long does my work permit application take?", "auto", "documents", False, 3),
        ("Where should I start networking for a job?", "auto", "work", False, 2),
        ("How do I apply for Kela benefits?", "auto", "benefits", False, 2),
        ("What should I check in a rental agreement?", "auto", "housing", False, 1),
        ("I need help with a rental agreement", "benefits", "benefits", True, 1),
        ("@Work, can you help with my residence permit?", "auto", "work", True, 2),
        ("@coordinator, where should I start?", "auto", "coordinator", True, 0),
        ("Email sam@Work.example.", "auto", "coordinator", False, 0),
        ("Performance of forms", "auto", "coordinator", False, 0),
        ("unemployment benefit", "auto", "benefits", False, 3),
        (None, None, "coordinator", False, 0),
        ("hello", "nobody", None, True, 0),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "message string, preferred string").coalesce(1)
    got = routing.route(df, DEFAULT_ROSTER).collect()
    assert [(r.guide_id, r.was_explicit, r.score) for r in got] == [c[2:] for c in cases]
    assert got[0].reason == "This looks like a immigration and legal processes question."


def test_top_k_is_exact_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[10] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 200)
    q = df.filter("id < 7").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in vectors.top_k(q, df, 4).collect()}
    for i in range(7):
        d = np.round(np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(1)), 6)
        assert [got[i, k + 1] for k in range(4)] == np.lexsort((np.arange(300), d))[:4].tolist()


def test_upsert_drops_stale_chunks(spark):
    old = spark.createDataFrame([("a:0", "a"), ("a:1", "a"), ("b:0", "b")], "chunk_id string, doc string")
    new = spark.createDataFrame([("a:0", "a")], "chunk_id string, doc string")
    assert vectors.upsert(old, new).count() == 3
    assert {r.chunk_id for r in vectors.upsert(old, new, delete_stale="doc").collect()} == {"a:0", "b:0"}


def test_html_is_cleaned():
    html = "<html><head><title>T &amp; t</title><script>x</script></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy</div><article><h2>Head</h2><p>Some <b>bold</b> text with <a href='/l'>link</a> in it<br>and more.</p><ul><li>one</li><li>two</li></ul></article><footer>f</footer></body></html>"
    title, md = extract.html_to_markdown(html)
    assert title == "T & t"
    assert md == "## Head\n\nSome **bold** text with [link](/l) in it\nand more.\n\n- one\n\n- two"
    raw = extract.html_to_markdown(html, extract.Profile(cleanup=False))[1]
    assert "Home" in raw and "Buy" in raw and "x" not in raw.split()
    assert extract.html_to_markdown(None) == ("", "") and extract.html_to_markdown("<p>Un<b>closed")[1] == "Un**closed"


def test_html_by_selectors_and_options():
    from siltstone.config import MarkdownOptions, Site

    html = "<body><div id='cookie-bar'>We use cookies</div><div class='wrap'><div class='main a' data-x='1'><p>Inside this part <a href='/l'>a long link text</a> here.</p></div><p>Beside it.</p></div><div role='dialog'>Sign up</div><main><p>Über “quotes” – naïve</p></main></body>"

    def of(**settings):
        return extract.html_to_markdown(html, extract.Profile.of(Site("s", "https://a.example", word_count_threshold=0, **settings)))[1]

    assert of() == "We use cookies\n\nInside this part [a long link text](/l) here.\n\nBeside it.\n\nSign up\n\nÜber “quotes” – naïve"
    assert of(css_selector=".wrap .main") == of(css_selector="div[data-x=1]") == of(target_elements=("h9", "div.main.a")) == "Inside this part [a long link text](/l) here."
    assert of(css_selector=".wrap", target_elements=("p",)) == "Inside this part [a long link text](/l) here.\n\nBeside it."
    assert of(css_selector="main .wrap") == "" and "Sign up" in extract.html_to_markdown(html, extract.Profile.of(Site("s", "https://a.example", css_selector="main"), cleanup=False))[1]
    assert of(remove_consent_popups=True, remove_overlay_elements=True) == "Inside this part [a long link text](/l) here.\n\nBeside it.\n\nÜber “quotes” – naïve"
    assert of(css_selector="main", markdown=MarkdownOptions(unicode_snob=False)) == 'Uber "quotes" - naive'
    assert of(css_selector=".main", markdown=MarkdownOptions(body_width=12)) == "Inside this\npart\n[a long link text](/l)\nhere."
    assert of(css_selector=".main", markdown=MarkdownOptions(body_width=12, protect_links=False)) == "Inside this\npart [a long\nlink\ntext](/l)\nhere."
    for bad in ("p > a", "", "p::before", "a,"):
        try:
            extract.selectors(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_folding_is_unicodes(spark):
    letters = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000 and (chr(c).casefold() != chr(c) or chr(c).lower() != chr(c))]
    texts = ["".join(letters[i : i + 50]) for i in range(0, len(letters), 50)] + ["Straße ΣΊΣΥΦΟΣ 𐐀 \U0001f389 İstanbul", "", None]
    df = spark.createDataFrame([(c,) for c in letters + texts[-3:]], "c string").coalesce(1)
    got = df.select("c", F.lower("c").alias("low"), text.casefold(F.col("c")).alias("f")).collect()
    # Letters that the two Unicode versions lower differently say nothing about folding.
    assert all(r.f == r.c.casefold() for r in got if r.c and len(r.c) == 1 and r.low == r.c.lower())
    assert sum(r.low == r.c.lower() for r in got[: len(letters)]) > 0.97 * len(letters)
    assert [r.f for r in got[-3:]] == [texts[-3].casefold(), "", None]


def test_sums_over_subtrees_and_what_goes():
    import random
    from xml.etree import ElementTree

    rng = random.Random(5)

    def grow(depth):
        e = ElementTree.Element(rng.choice(["div", "ul", "li", "p", "section", "span"]))
        e.text = " ".join(rng.choice(["word", "longer", "x"]) for _ in range(rng.randrange(6)))
        for _ in range(rng.randrange(4) if depth else 0):
            e.append(grow(depth - 1))
        return e

    for _ in range(50):
        root = grow(5)
        order = list(root.iter())
        number, above = {id(e): i for i, e in enumerate(order)}, {id(c): e for e in order for c in e}
        reader = extract._Reader(extract.Profile())
        reader.feed(ElementTree.tostring(root, encoding="unicode", short_empty_elements=False))
        parents = [number[id(above[id(e)])] if id(e) in above else -1 for e in order]
        assert [e[0] for e in reader.elements] == parents
        sums = extract.subtree_sums(parents, reader.own)
        for e, got in zip(order, sums, strict=True):
            inside = list(e.iter())
            assert got == [sum(len(x.text) for x in inside), 0, sum(2 * len(x.tag) + 5 for x in inside), sum(len(x.text.split()) for x in inside)]
        gone = extract.pruned(reader.elements, reader.own, 20, 0.45)

        def low(e):
            t, _, m, w = sums[number[id(e)]]
            return t > 0 and e.tag != "span" and extract.score(extract._TAG_WEIGHT[e.tag], False, t, 0, m, w, 20) < 0.45

        def holds(e):
            dense = e.tag != "span" and sums[number[id(e)]][3] >= 20 and not low(e)
            return dense or any(map(holds, e))

        for i, e in enumerate(order):
            assert gone[i] == (low(e) and not holds(e) or parents[i] >= 0 and gone[parents[i]])


def test_nested_boilerplate_goes_with_what_holds_it():
    words = "This guidance explains who may apply, what the application costs and how long a decision takes. "
    links = "".join(f'<li class="item"><a href="/section/page-{i}.html" title="Go to page {i}">Page number {i}</a></li>' for i in range(40))
    page = (
        f'<body><div class="wrap"><div class="sidebar"><div><ul>{links}</ul></div></div>'
        f'<div><div class="teaser-list"><div><p>Read more</p><p><a href="/x">Another story that is somewhere else</a></p></div></div>'
        f'<section><h2>Fees</h2><p>{words * 2}</p><div class="inner"><p>{words}</p></div></section></div>'
        f'<div class="share"><span><a href="/a">Share</a></span></div><ul>{links}</ul></div></body>'
    )
    md = extract.html_to_markdown(page)[1]
    assert md == "## Fees\n\n" + (words * 2).strip() + "\n\n" + words.strip()
    whole = extract.html_to_markdown(page, extract.Profile(cleanup=False))[1]
    assert len(md) < 0.1 * len(whole) + len(words) * 3
    assert extract.html_to_markdown(f"<body><ul>{links}</ul></body>")[1].startswith("- [Page number 0]")  # nothing else is there


def test_roster_listing(spark):
    assert [r.id for r in routing.listing(spark).collect()] == [g.id for g in DEFAULT_ROSTER]


def test_answers_and_failures(spark):
    col = vectors.embed(spark.createDataFrame([(1, "permits take time", "https://a.example", None, None, None), (2, "rent is due", None, "", None, "Rent")], "id long, page_content string, source_url string, url string, citation_url string, title string"))
    q = spark.createDataFrame([(7, "permits take time", "auto")], "query_id long, message string, preferred string")
    done = rag.events(rag.answer(q, col, k=2)).orderBy("seq").collect()
    assert [e.event for e in done] == ["routing", "citation", "token", "token", "token", "done"]
    assert '"source_url":"https://a.example"' in done[1].data and '"source_url":"Unknown source"' in done[1].data
    state = rag.fold_events(rag.events(rag.answer(q, col, k=2))).first()
    assert state.content == "permits take time " and state.finished and state.error is None

    def broken(prompts):
        raise RuntimeError

    failed = rag.events(rag.answer(q, col, generator=broken)).orderBy("seq").collect()
    assert [e.event for e in failed] == ["routing", "citation", "error"]


def test_one_failed_turn_fails_alone(spark):
    col = vectors.embed(spark.createDataFrame([(1, "permits take time", None, None, None, None)], "id long, page_content string, source_url string, url string, citation_url string, title string"))
    history = [("user", f"m{i}") for i in range(20)]
    q = spark.createDataFrame([(1, "fine", "auto", history), (2, "bad", "auto", None), (3, "fine", "nobody", None)], "query_id long, message string, preferred string, history array<struct<role:string,content:string>>").coalesce(1)

    def picky(turns):
        if any("Question: bad" in t[-1]["content"] for t in turns):
            raise RuntimeError
        return [[f"{len(t)} {t[0]['role']} {t[1]['content']}"] for t in turns]

    got = {}
    for e in rag.events(rag.answer(q, col, base_prompt="Be brief.", generator=picky)).orderBy("query_id", "seq").collect():
        got.setdefault(e.query_id, []).append((e.event, e.data))
    assert got[1][2:] == [("token", '{"text":"12 system m10"}'), ("done", "{}")]
    assert [e for e, _ in got[2]] == ["routing", "citation", "error"] and [e for e, _ in got[3]] == ["error"]


def test_top_k_does_not_depend_on_batches(spark):
    """Near and equal vectors with large norms, in one batch and in many."""
    rng = np.random.default_rng(8)
    x = (1000 + rng.standard_normal((400, 16)) * 1e-3).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = np.round(np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)), 6) + 0.0
    want = {(i, r + 1): (int(j), d[i, j]) for i in range(0, 400, 50) for r, j in enumerate(np.lexsort((np.arange(400), d[i]))[:5])}
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(parts)
        q = df.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
        assert {(r.query_id, r["rank"]): (r.id, r.distance) for r in vectors.top_k(q, df, 5).collect()} == want


def test_prompts_from_files(spark, tmp_path):
    from siltstone.sources import prompts

    (tmp_path / "a.md").write_text("Hi $name, $$5 ${name}x $other $ 1")
    (tmp_path / "a.txt").write_text("no")
    (tmp_path / "b.txt").write_text("plain")
    assert prompts.load(spark, f"file://{tmp_path}", "b") == "plain" and prompts.load(spark, str(tmp_path), "c") == ""
    assert spark.range(1).select(prompts.filled(spark, str(tmp_path), "a", {"name": F.lit("$other")})).first()[0] == "Hi $other, $5 $otherx $other $ 1"


def test_add_document(spark):
    held = vectors.embed(spark.createDataFrame([("a:0", "old")], "chunk_id string, page_content string"))
    out = vectors.add_document(held, spark.createDataFrame([("a:0", "new"), ("b:0", "more"), ("c:0", " ")], "chunk_id string, page_content string"))
    assert {(r.chunk_id, r.page_content, len(r.embedding)) for r in out.collect()} == {("a:0", "new", 384), ("b:0", "more", 384)}


def test_template_is_filled_once(spark):
    got = spark.range(1).select(text.fill("$context|$question", F.lit("a $question"), F.lit("b $context"))).first()[0]
    assert got == "a $question|b $context"
