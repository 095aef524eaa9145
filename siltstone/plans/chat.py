"""Queries over conversations: routing, history, prompts and event streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import rag, routing
from siltstone.operators.routing import Guide
from siltstone.plans.catalog import SQL, query, table
from siltstone.staging import shared_root
from siltstone.streaming.turns import FOLDED, fold_turns

# The conversations are invented prose, so the test roster's terms are words that occur in it.
ROSTER = (
    Guide("chief", "Chief", "General"),
    Guide("alpha", "Alpha", "First Topic", ("the", "of the", "in")),
    Guide("beta", "Beta", "Second Topic", ("de", "de la", "le")),
    Guide("gamma", "Gamma", "Third Topic", ("der", "und", "die")),
)


def messages(spark, sf_dir) -> DataFrame:
    """User turns; some name a guide, some choose one."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    m = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("@beta, "), F.col("text"))).when(F.col("conv_id") % 5 == 1, F.concat(F.lit("mail me@Gamma.example "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", m.alias("message"), F.when(F.col("turn") % 6 == 2, "gamma").otherwise("auto").alias("preferred"))


_MESSAGE = "CASE WHEN conv_id % 5 = 0 THEN '@beta, ' || text WHEN conv_id % 5 = 1 THEN 'mail me@Gamma.example ' || text ELSE text END"
_SIGN = r"[^\p{L}\p{M}\p{N}_]"


def _score_sql(guide: Guide) -> str:
    """Every sign is doubled first, so that two terms next to each other don't share the one between them."""
    parts = [f"{len(t.split())} * len(regexp_extract_all(doubled, '{_SIGN}{t.replace(' ', '  ')}{_SIGN}'))" for t in guide.terms]
    return f"CAST({' + '.join(parts)} AS BIGINT) AS {guide.id}"


SCORES_SQL = (
    rf"WITH p AS (SELECT conv_id, turn, regexp_replace(' ' || lower({_MESSAGE}) || ' ', '({_SIGN})', '\1\1', 'g') AS doubled FROM conversations WHERE role = 'user') "
    f"SELECT conv_id, turn, {', '.join(_score_sql(g) for g in ROSTER[1:])} FROM p"
)


@query(SCORES_SQL)
def agent_score(spark, sf_dir):
    low = F.lower("message")
    return messages(spark, sf_dir).select("conv_id", "turn", *[routing.score(low, g).cast("long").alias(g.id) for g in ROSTER[1:]])


def _route_sql() -> str:
    return (
        "WITH s AS ("
        + SCORES_SQL
        + """), r AS (SELECT s.*, greatest(alpha, beta, gamma) AS best, CASE WHEN turn % 6 = 2 THEN 'gamma' END AS chosen, CASE WHEN conv_id % 5 = 0 THEN 'beta' END AS named FROM s)
 SELECT conv_id, turn, coalesce(chosen, named, CASE WHEN best = 0 THEN 'chief' WHEN alpha = best THEN 'alpha' WHEN beta = best THEN 'beta' ELSE 'gamma' END) AS guide_id,
 CASE WHEN chosen IS NOT NULL THEN 'You selected this guide.' WHEN named IS NOT NULL THEN 'You mentioned @Beta.' WHEN best = 0 THEN 'Chief will clarify the best next step before involving a specialist.'
 ELSE 'This looks like a ' || CASE WHEN alpha = best THEN 'first topic' WHEN beta = best THEN 'second topic' ELSE 'third topic' END || ' question.' END AS reason, chosen IS NOT NULL OR named IS NOT NULL AS was_explicit, best AS score FROM r"""
    )


@query(_route_sql())
def agent_route(spark, sf_dir):
    return routing.route(messages(spark, sf_dir), ROSTER).select("conv_id", "turn", "guide_id", "reason", "was_explicit", "score")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND conv_id % 5 = 0 AND turn % 6 <> 2")
def agent_mention(spark, sf_dir):
    return routing.route(messages(spark, sf_dir), ROSTER).filter("reason = 'You mentioned @Beta.'").select("conv_id", "turn")


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, turn, role, text FROM h WHERE r <= 3""")
def history_tail(spark, sf_dir):
    """The last three messages of each conversation, in table form."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("conv_id", "turn", "role", "text")


_MESSAGES_SQL = """WITH c AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS h FROM conversations GROUP BY conv_id),
 m AS (SELECT conv_id, list_concat(CASE WHEN conv_id % 2 = 0 THEN [{'role': 'system', 'content': 'Be brief.'}] ELSE [] END, list_concat(h[greatest(len(h) - 3, 1):len(h)], [{'role': 'user', 'content': 'What now?'}])) AS ms FROM c)
"""


@query(_MESSAGES_SQL + "SELECT conv_id, CAST(i AS BIGINT) AS pos, ms[i].role AS role, ms[i].content AS content FROM m, unnest(generate_series(1, len(ms))) AS t(i)")
def build_messages(spark, sf_dir):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))  # ranked first, so no group holds a whole conversation
    h = table(spark, sf_dir, "conversations").withColumn("r", F.row_number().over(last)).filter("r <= 4").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("h"))
    ms = text.messages(F.when(F.col("conv_id") % 2 == 0, "Be brief."), text.history_tail(F.col("h"), 4), F.lit("What now?"))
    return h.select("conv_id", F.posexplode(ms).alias("p", "m")).select("conv_id", (F.col("p") + 1).cast("long").alias("pos"), "m.role", "m.content")


@query("""SELECT conv_id, turn, 'Be kind.' || CASE WHEN conv_id % 3 = 0 THEN chr(10) || chr(10) || 'Specialist.' ELSE '' END AS system, '<<<' || chr(10) || text || ' $question' || chr(10) || '>>> Question: ' || role || chr(10) AS prompt FROM conversations""")
def prompt_render(spark, sf_dir):
    system = text.system_prompt(F.lit("Be kind."), F.when(F.col("conv_id") % 3 == 0, "Specialist."))
    prompt = text.fill("<<<\n$context\n>>> Question: $question\n", F.concat(F.col("text"), F.lit(" $question")), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", system.alias("system"), prompt.alias("prompt"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN text || chr(10) || role ELSE '' END AS content FROM conversations""")
def flatten_content(spark, sf_dir):
    blocks = F.when(F.col("turn") % 3 == 1, F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text"))))
    out = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.coalesce(text.flatten_blocks(blocks), F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("content"))


def turns(spark, sf_dir) -> DataFrame:
    """Answered turns as event rows: the tokens are an assistant message's words; one turn in seven fails."""
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    words = F.transform(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda w: F.concat(w, F.lit(" ")))
    cites = F.array(F.struct(F.concat(F.lit("https://a.example/"), F.col("query_id").cast("string")).alias("source"), F.lit("A title").alias("title"), F.substring("text", 1, 20).alias("snippet")))
    return rag.events(a.select("query_id", F.lit("chief").alias("guide_id"), F.lit("Because.").alias("reason"), F.lit(False).alias("was_explicit"), cites.alias("citations"), F.when(F.col("query_id") % 7 != 0, words).alias("tokens")), ROSTER)


_TURNS_SQL = """WITH a AS (SELECT conv_id * 1000 + turn AS query_id, list_transform(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' '), lambda w: w || ' ') AS t FROM conversations WHERE role = 'assistant')"""


@query(_TURNS_SQL + """SELECT query_id, e AS event, count(*) AS n FROM (SELECT query_id, unnest(list_concat(['routing', 'citation'], CASE WHEN query_id % 7 = 0 THEN ['error'] ELSE list_concat(list_transform(t, lambda w: 'token'), ['done']) END)) AS e FROM a) GROUP BY 1, 2""")
def sse_events(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("query_id", "event").agg(F.count("*").alias("n"))


@query(
    _TURNS_SQL.replace("FROM conversations", ", text FROM conversations")
    + """SELECT query_id, 'chief' AS agent_id, 'Chief' AS name, '' AS title, 'General' AS category, 'Because.' AS reason, 'false' AS was_explicit, 'https://a.example/' || query_id AS source_url, 'A title' AS cited, substr(text, 1, 20) AS snippet FROM a"""
)
def event_payloads(spark, sf_dir):
    """What a client reads in the routing and citation events of each turn."""
    def field(event, path):
        return F.max(F.when(F.col("event") == event, F.get_json_object("data", path)))

    routed = [field("routing", f"$.{n}").alias(n) for n in ("agent_id", "name", "title", "category", "reason", "was_explicit")]
    cited = [field("citation", f"$.citations[0].{n}").alias(a) for n, a in (("source_url", "source_url"), ("title", "cited"), ("snippet", "snippet"))]
    return turns(spark, sf_dir).groupBy("query_id").agg(*routed, *cited)


@query(_TURNS_SQL + """SELECT query_id, CASE WHEN query_id % 7 = 0 THEN '' ELSE array_to_string(t, '') END AS content, 'chief' AS guide_id, CASE WHEN query_id % 7 = 0 THEN 'I encountered an error while processing your query. Please try again.' END AS error, query_id % 7 <> 0 AS finished FROM a""")
def chat_fold(spark, sf_dir):
    return rag.fold_events(turns(spark, sf_dir))


@query("""SELECT conv_id, turn, CAST(i AS BIGINT) AS pos, CASE i WHEN 0 THEN 'token' WHEN 1 THEN 'message' ELSE 'done' END AS event, CASE i WHEN 0 THEN replace(text, chr(10), ' ') || chr(10) || role WHEN 1 THEN '1' ELSE '{}' END AS data FROM conversations, range(3) AS t(i)""")
def sse_parse(spark, sf_dir):
    """Captured event streams with mixed line ends, a comment block and a block without data."""
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    body = F.concat(F.lit("event: token\r\ndata: "), line, F.lit("\r\ndata: "), F.col("role"), F.lit("\r\n\r\n: ping\n\nevent: nothing\n\ndata: 1\n\nevent: done\ndata: {}\n\n"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.sse_blocks(body)).alias("p", "e"))
    return c.select("conv_id", "turn", F.col("p").cast("long").alias("pos"), "e.event", "e.data")


@query(SQL["chat_fold"])
def turn_stream(spark, sf_dir):
    """The same fold over events that come as a stream of four files, out of order."""
    root = f"{shared_root(spark).rstrip('/')}/siltstone-turns-{uuid.uuid4().hex}"
    ddl = "query_id long, seq int, event string, data string, ts timestamp"
    rows = turns(spark, sf_dir).select("query_id", "seq", "event", "data", F.timestamp_seconds(F.lit(1_785_888_000) + F.col("seq")).alias("ts"))
    rows.repartition(4, F.xxhash64("query_id", "seq")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    fold_turns(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(FOLDED).parquet(f"{root}/out")
