"""Data-set management on the driver's tables: splits, filters, histograms, cascades, queues, audits, changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score, text
from ..operators import datasets, paging, review, tables
from .catalogue import Tables, query

_BUCKET = "CAST(('0x' || substr(sha256('{salt}:' || {key}), 1, 8)) AS BIGINT) % 100"


def _split_sql(key: str, salt: str = datasets.SPLIT_SALT) -> str:
    bucket = _BUCKET.format(salt=salt, key=key)
    return f"CASE WHEN {bucket} < 10 THEN 'test' WHEN {bucket} < 20 THEN 'val' ELSE 'train' END"


@query(
    "doc_id string, split string",
    f"""SELECT doc_id, {_split_sql('lead')} AS split FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY text) AS lead
        FROM documents)""",
)
def split_assign(t: Tables) -> DataFrame:
    """Splits by bucket of the smallest id that has the same text."""
    return datasets.compute_splits(t("documents"), "doc_id", [F.sha2("text", 256)])


@query(
    "doc_id string, split string",
    f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS k, text FROM documents),
    old AS (SELECT k, {_split_sql('k', 'older')} AS s FROM d WHERE CAST(k AS BIGINT) % 2 = 0),
    g AS (SELECT k, min(k) OVER (PARTITION BY text) AS lead FROM d WHERE CAST(k AS BIGINT) % 10 <> 4)
    SELECT g.k AS doc_id, coalesce(o.s, l.s, {_split_sql('g.lead')}) AS split FROM g LEFT JOIN old o ON o.k = g.k LEFT JOIN old l ON l.k = g.lead""",
)
def split_sticky(t: Tables) -> DataFrame:
    """Recorded ids (the even ones) keep their splits, new ones inherit or are hashed, vanished ones go."""
    docs = t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    key = F.col("doc_id").cast("string")
    old = docs.where("doc_id % 2 = 0").select(key.alias("doc_id"), score.assign_split(key, "older").alias("split"))
    return datasets.sticky_splits(docs.where("doc_id % 10 <> 4"), "doc_id", "digest", old)


@query(
    "digest string, splits string",
    f"""SELECT sha256(text) AS digest, string_agg(DISTINCT s, ',' ORDER BY s) AS splits
        FROM (SELECT text, {_split_sql('CAST(doc_id AS VARCHAR)')} AS s
        FROM documents) GROUP BY text HAVING count(DISTINCT s) > 1""",
)
def split_leaks(t: Tables) -> DataFrame:
    """Texts that stand in several splits when ids are split without regard to texts."""
    rows = t("documents").select(F.sha2("text", 256).alias("digest"), score.assign_split(F.col("doc_id").cast("string"), datasets.SPLIT_SALT).alias("split"))
    return datasets.split_leaks(rows, ["digest"])


@query(
    "c_mktsegment string, digest string",
    f"""SELECT c_mktsegment, substr(sha256(string_agg(c_name || '=' || {_split_sql('c_name')}, chr(10)
        ORDER BY c_name)), 1, 16) AS digest FROM customer GROUP BY c_mktsegment""",
)
def splits_digest(t: Tables) -> DataFrame:
    """One digest of the sorted name=split lines of each segment; a report over tables of names."""
    line = F.concat(F.col("c_name"), F.lit("="), score.assign_split("c_name", datasets.SPLIT_SALT))
    return t("customer").groupBy("c_mktsegment").agg(text.ordered_digest(line).alias("digest"))


@query(
    "train bigint, val bigint, test bigint",
    f"""SELECT count(*) FILTER (s = 'train') AS train, count(*) FILTER (s = 'val') AS val, count(*) FILTER (s = 'test') AS test
        FROM (SELECT {_split_sql('CAST(doc_id AS VARCHAR)')} AS s FROM documents)""",
)
def split_counts(t: Tables) -> DataFrame:
    """Rows of each split, zeros included."""
    return datasets.split_counts(t("documents").select(score.assign_split(F.col("doc_id").cast("string"), datasets.SPLIT_SALT).alias("split")))


@query(
    "doc_id bigint, source string",
    """SELECT d.doc_id, source FROM documents d JOIN labels l ON l.doc_id = d.doc_id
        WHERE lang = 'en' AND toxic = 1 AND contains(lower(concat_ws(' ', CAST(d.doc_id AS VARCHAR),
        text, source)), 'the an')""",
)
def filter_composite(t: Tables) -> DataFrame:
    """Several optional conditions, a flag from a join and a case-insensitive part of joined columns."""
    rows = t("documents").join(t("labels").select("doc_id", (F.col("toxic") == 1).alias("is_toxic")), "doc_id", "left")
    return datasets.filter_rows(rows, query="THE an", query_columns=["doc_id", "text", "source"], equals={"lang": "en", "source": None}, flags=["is_toxic"])


@query("o_orderkey bigint, o_totalprice double", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 1000")
def page_slice(t: Tables) -> DataFrame:
    """The third page of 500 rows."""
    return tables.page_of(t("orders"), ["o_orderkey"], 2, 500)


@query(
    "page bigint, l_orderkey bigint, l_linenumber bigint, l_extendedprice double, l_partkey bigint",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS k, count(*) OVER () AS n FROM lineitem)
        SELECT k // 50 AS page, l_orderkey, l_linenumber, l_extendedprice, l_partkey FROM r WHERE k // 50 IN (0, n // 100, (n - 1) // 50)""",
)
def deep_pages(t: Tables) -> DataFrame:
    """The first page of all line items by price, one from the middle and the last one."""
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ordered = paging.OrderedTable(t("lineitem"), order)
    numbers = sorted({0, ordered.total // 100, max(0, (ordered.total - 1) // 50)})
    return reduce(DataFrame.unionByName, [ordered.page(n, 50).withColumn("page", F.lit(n)) for n in numbers])


@query("value string, count bigint", "SELECT lang AS value, count(*) AS count FROM documents GROUP BY lang")
def hist_class(t: Tables) -> DataFrame:
    """Documents of each class."""
    return datasets.histogram(t("documents"), F.col("lang"))


@query(
    "value string, count bigint",
    """SELECT coalesce(nullif(CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END, ''),
        'unregistered') AS value, count(*) AS count FROM documents GROUP BY 1""",
)
def hist_source(t: Tables) -> DataFrame:
    """Documents of each source, those without one under a name of their own."""
    return datasets.histogram(t("documents"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("source")), missing="unregistered")


@query(
    "value string, count bigint",
    """SELECT CASE WHEN event_type = 'error' THEN 'net' WHEN event_type = 'signup' THEN 'second_opinion' WHEN user_id % 5 = 0 THEN 'queue' WHEN user_id % 7 = 0 THEN 'dataset' WHEN value > 50 THEN 'corrected' ELSE 'accepted' END AS value,
        count(*) AS count FROM events GROUP BY 1""",
)
def hist_route(t: Tables) -> DataFrame:
    """Events by the first route that applies."""
    c = F.col
    return datasets.histogram(t("events"), score.label_route(c("event_type") == "error", c("event_type") == "signup", c("user_id") % 5 == 0, c("user_id") % 7 == 0, c("value") > 50))


@query(
    "largest string, smallest string, ratio double, absent string, alert boolean",
    """WITH h AS (SELECT lang AS v, count(*) AS n FROM documents WHERE lang IN ('en','fr','de','es')
        GROUP BY lang) SELECT arg_max(v, (n, v)) AS largest, arg_min(v, (n, v)) AS smallest, max(n) / min(n) AS ratio, 'it' AS absent,
        true AS alert FROM h""",
)
def imbalance(t: Tables) -> DataFrame:
    """Largest and smallest class, and classes that are missing."""
    return datasets.imbalance(datasets.histogram(t("documents"), F.col("lang")), ["en", "fr", "de", "es", "it"])


@query(
    "value string, count bigint, share double",
    """WITH h AS (SELECT props AS value, count(*) AS count FROM events
        GROUP BY props) SELECT value, count, CAST(count AS DOUBLE) / (SELECT sum(count)
        FROM h) AS share FROM h WHERE CAST(count AS DOUBLE) / (SELECT sum(count)
        FROM h) < 0.01""",
)
def rare_classes(t: Tables) -> DataFrame:
    """Property values with less than a hundredth of the events."""
    return datasets.rare(datasets.histogram(t("events"), F.col("props")), 0.01)


@query(
    "value string, weight double",
    """WITH c AS (SELECT unnest(['click','view','error','refund']) AS value),
        h AS (SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IN ('click','view','error','refund')
        GROUP BY 1) SELECT c.value, coalesce(CAST((SELECT sum(n) FROM h) AS DOUBLE) / (4 * h.n),
        0) AS weight FROM c LEFT JOIN h ON h.value = c.value""",
)
def class_weights(t: Tables) -> DataFrame:
    """Balanced weights; an absent class weighs nothing."""
    return datasets.class_weights(datasets.histogram(t("events"), F.col("event_type")), ["click", "view", "error", "refund"])


@query(
    "doc_id bigint, first_source string, first_id bigint",
    """SELECT doc_id, CASE WHEN n > 1 THEN fs END AS first_source, CASE WHEN n > 1 THEN fi END AS first_id
        FROM (SELECT doc_id, row_number() OVER w AS n, first_value(source) OVER w AS fs, first_value(doc_id) OVER w AS fi
        FROM documents WINDOW w AS (PARTITION BY text ORDER BY source, doc_id))""",
)
def dup_pointer(t: Tables) -> DataFrame:
    """Each repeat of a text points to its first occurrence in (source, id) order."""
    rows = review.duplicate_pointers(t("documents").select("doc_id", "source", F.sha2("text", 256).alias("digest")), ["digest"], ["source", "doc_id"])
    return rows.select("doc_id", F.col("duplicate_of.source").alias("first_source"), F.col("duplicate_of.doc_id").alias("first_id"))


@query(
    "o_orderkey bigint, verdict string, reason string",
    """WITH r AS (SELECT o.*, c_mktsegment, c_acctbal FROM orders o LEFT JOIN customer c ON c_custkey = o_custkey AND c_acctbal > 0)
    SELECT o_orderkey, CASE WHEN coalesce(c_acctbal > 9500, false) THEN 'rejected' WHEN coalesce(c_mktsegment = 'BUILDING', false) OR o_orderpriority = '1-URGENT' OR o_orderstatus = 'F' OR o_totalprice / 500000 < 0.2 THEN 'review' ELSE 'accepted' END AS verdict,
    CASE WHEN coalesce(c_acctbal > 9500, false) THEN 'fatal' WHEN coalesce(c_mktsegment = 'BUILDING', false) THEN 'orientation' WHEN o_orderpriority = '1-URGENT' THEN 'side_conflict' WHEN o_orderstatus = 'F' THEN 'turn_flip' WHEN o_totalprice / 500000 < 0.2 THEN 'low_confidence' ELSE '' END AS reason FROM r""",
)
def verdict_partition(t: Tables) -> DataFrame:
    """The gate's cascade, where what is unknown (an unmatched join) doesn't condemn."""
    c = F.col
    rows = t("orders").join(t("customer").where("c_acctbal > 0"), c("c_custkey") == c("o_custkey"), "left")
    return review.gated(rows, score.verdict(c("c_acctbal") > 9500, c("c_mktsegment") == "BUILDING", c("o_orderpriority") == "1-URGENT", c("o_orderstatus") != "F", c("o_totalprice") / 500000, 0.2))


@query(
    "doc_id bigint, side string, source string, conflicting boolean",
    """WITH r AS (SELECT d.doc_id, CASE WHEN lang = 'en' THEN 'w' WHEN lang = 'fr' THEN 'b' END AS dec, CASE WHEN quality = 1 AND toxic = 0 THEN 'w' WHEN quality = 0 THEN 'b' END AS prov FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT doc_id, CASE WHEN dec IS NOT NULL AND (prov IS NULL OR prov = dec) THEN dec ELSE coalesce(prov, 'w') END AS side, CASE WHEN dec IS NOT NULL AND (prov IS NULL OR prov = dec) THEN 'text' WHEN prov IS NOT NULL THEN 'legality' ELSE 'default' END AS source, dec IS NOT NULL AND prov IS NOT NULL AND dec <> prov AS conflicting FROM r""",
)
def side_cascade(t: Tables) -> DataFrame:
    """Declared side, unless proof says otherwise; then proof; then the default."""
    rows = t("documents").join(t("labels"), "doc_id", "left")
    declared = F.when(F.col("lang") == "en", "w").when(F.col("lang") == "fr", "b")
    proven = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "w").when(F.col("quality") == 0, "b")
    s = score.side_to_move(declared, F.lit("text"), proven)
    return rows.select("doc_id", s["side"].alias("side"), s["source"].alias("source"), s["conflicting"].alias("conflicting"))


@query(
    "l_orderkey bigint, l_linenumber bigint, rule string, flipped boolean, ambiguous boolean, answers bigint",
    """WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_linenumber % 2 = 0 END AS co, l_linestatus = 'O' AS up, l_quantity < 20 AS fl, (l_discount - 0.05) * 10 AS m, l_tax * 100 - 4 AS g FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN co IS NOT NULL THEN 'coordinates' WHEN up <> fl THEN 'legality' WHEN abs(m) >= 0.2 THEN 'margin' WHEN abs(g) >= 1 THEN 'pawns' ELSE 'fallback' END AS rule,
    CASE WHEN co IS NOT NULL THEN co WHEN up <> fl THEN fl WHEN abs(m) >= 0.2 THEN m < 0 WHEN abs(g) >= 1 THEN g < 0 ELSE m < 0 END AS flipped,
    CASE WHEN co IS NOT NULL THEN false WHEN up <> fl THEN (m < 0) <> fl WHEN abs(m) >= 0.2 OR abs(g) >= 1 THEN false ELSE true END AS ambiguous,
    (co IS NOT NULL)::INT + (up <> fl)::INT + (abs(m) >= 0.2)::INT + (abs(g) >= 1)::INT + 1 AS answers FROM r""",
)
def rule_cascade(t: Tables) -> DataFrame:
    """The first of five ordered rules that has an answer, and how many have one."""
    c = F.col
    args = (F.when(c("l_returnflag") == "A", c("l_linenumber") % 2 == 0), c("l_linestatus") == "O", c("l_quantity") < 20, (c("l_discount") - F.lit(0.05)) * F.lit(10.0), c("l_tax") * F.lit(100.0) - 4)
    o = score.orientation(*args)
    return t("lineitem").select("l_orderkey", "l_linenumber", o["rule"].alias("rule"), o["flipped"].alias("flipped"), o["ambiguous"].alias("ambiguous"), F.size(score.orientation_rules(*args)).alias("answers"))


def _items(t: Tables) -> DataFrame:
    """Documents as review items: page is the id by tens, diagram its last digit."""
    c = F.col
    rows = t("documents").join(t("labels"), "doc_id", "left")
    confidence = (c("n_chars") % 100) / F.lit(100.0)
    p = score.review_priority(c("quality") == 0, c("toxic") == 1, c("lang") == "es", c("doc_id") % 11 == 0, c("doc_id") % 13 == 0, confidence, c("n_chars") > 20000, (c("n_chars") % 7) / F.lit(7.0), F.when(c("lang") == "de", 2).otherwise(0), c("doc_id") % 5 == 0)
    return rows.select("doc_id", F.expr("doc_id div 10").alias("page"), (c("doc_id") % 10).alias("diagram"), confidence.alias("confidence"), p["priority"].alias("priority"), p["reasons"].alias("reasons"))


_ITEMS_SQL = """SELECT doc_id, doc_id // 10 AS page, doc_id % 10 AS diagram, conf AS confidence,
    CASE WHEN free THEN 10.0 * ((n_chars % 7) / 7.0) ELSE 0.0 END + CASE WHEN r1 THEN 1000.0 ELSE 0.0 END + CASE WHEN r2 THEN 500.0 ELSE 0.0 END + CASE WHEN r3 THEN 250.0 ELSE 0.0 END + CASE WHEN r4 THEN 120.0 ELSE 0.0 END + CASE WHEN r5 THEN 120.0 ELSE 0.0 END + CASE WHEN r6 THEN 100.0 * (CAST(0.8 AS DOUBLE) - conf) ELSE 0.0 END + CASE WHEN r7 THEN 30.0 ELSE 0.0 END + CASE WHEN r8 THEN 10.0 ELSE 0.0 END AS priority,
    list_filter([CASE WHEN r1 THEN 'illegal' END, CASE WHEN r2 THEN 'orientation' END, CASE WHEN r3 THEN 'sources' END, CASE WHEN r4 THEN 'side_conflict' END, CASE WHEN r5 THEN 'turn_flip' END, CASE WHEN r6 THEN 'low_confidence' END, CASE WHEN r7 THEN 'repaired' END, CASE WHEN r8 THEN 'rare_class' END], lambda x: x IS NOT NULL) AS reasons
    FROM (SELECT *, free AND coalesce(quality = 0, false) AS r1, free AND coalesce(toxic = 1, false) AS r2, free AND lang = 'es' AS r3, doc_id % 11 = 0 AS r4, doc_id % 13 = 0 AS r5, free AND conf < CAST(0.8 AS DOUBLE) AS r6, free AND n_chars > 20000 AS r7, free AND lang = 'de' AS r8
    FROM (SELECT d.*, quality, toxic, d.doc_id % 5 <> 0 AS free, CAST(n_chars % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""


@query(
    "doc_id bigint, priority double, reasons string",
    f"""SELECT doc_id, round(priority, 6) AS priority, array_to_string(reasons, ',') AS reasons
        FROM ({_ITEMS_SQL}) WHERE len(reasons) > 0 ORDER BY priority DESC, page, diagram LIMIT 200""",
)
def priority_queue(t: Tables) -> DataFrame:
    """The 200 most urgent review items with their reasons."""
    return review.queue(_items(t), 200).select("doc_id", F.round("priority", 6).alias("priority"), F.array_join("reasons", ",").alias("reasons"))


@query(
    "error_rate double",
    f"""SELECT avg(CASE WHEN confidence < 0.8 OR len(list_filter(reasons, lambda r: regexp_matches(r, '^(illegal|sources|side)'))) > 0 THEN 1.0 ELSE 0.0 END) AS error_rate
        FROM ({_ITEMS_SQL})""",
)
def error_rate(t: Tables) -> DataFrame:
    """The share of items below the gate or with a reason of certain kinds."""
    return review.error_rate(_items(t), F.col("confidence"), F.col("reasons"))


@query(
    "page bigint, diagram bigint, score double, status string",
    """WITH e AS (SELECT user_id AS page, event_id AS diagram, value AS score, CASE WHEN event_type = 'click' THEN 'done' ELSE 'pending' END AS status FROM events),
    old AS (SELECT * FROM e WHERE diagram % 3 <> 0), new AS (SELECT page, diagram, score * 2 AS score, 'pending' AS status FROM e WHERE page % 2 = 0 AND diagram % 5 <> 0)
    SELECT n.page, n.diagram, n.score, coalesce(o.status, n.status) AS status FROM new n LEFT JOIN old o USING (page, diagram) UNION ALL SELECT page, diagram, score, status FROM old WHERE page NOT IN (SELECT page FROM new)""",
)
def queue_merge(t: Tables) -> DataFrame:
    """A fresh scan of some pages keeps decided statuses; other pages' items stay."""
    e = t("events").select(F.col("user_id").alias("page"), F.col("event_id").alias("diagram"), F.col("value").alias("score"), F.when(F.col("event_type") == "click", "done").otherwise("pending").alias("status"))
    fresh = e.where("page % 2 = 0 and diagram % 5 <> 0").select("page", "diagram", (F.col("score") * 2).alias("score"), F.lit("pending").alias("status"))
    return review.merge_queues(e.where("diagram % 3 <> 0"), fresh)


@query(
    "doc_id bigint, issue string",
    """WITH x AS (SELECT d.doc_id, [CASE WHEN n_chars > 10000 THEN 'long' END, CASE WHEN lang = 'es' THEN 'language' END, CASE WHEN contains(text, '***') THEN 'marks' END, CASE WHEN l.doc_id IS NULL THEN 'missing_file' END] AS i FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id)
    SELECT doc_id, issue FROM (SELECT doc_id, unnest(i) AS issue FROM x) WHERE issue IS NOT NULL""",
)
def audit_labels(t: Tables) -> DataFrame:
    """Every issue of every row, and rows without a match."""
    c = F.col
    return datasets.audit(t("documents"), t("labels"), "doc_id", {"long": c("n_chars") > 10000, "language": c("lang") == "es", "marks": F.contains("text", F.lit("***"))})


@query("doc_id bigint", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def audit_orphans(t: Tables) -> DataFrame:
    """Rows that no label names."""
    return datasets.orphans(t("documents"), t("labels"), "doc_id").select("doc_id")


@query(
    "violations string",
    """SELECT 'fatal,missing' || CASE WHEN (SELECT sum(n - 1) FROM (SELECT count(*) AS n
        FROM documents GROUP BY text)) > 0.1 * (SELECT count(*) FROM documents) THEN ',duplicates' ELSE '' END AS violations""",
)
def audit_violations(t: Tables) -> DataFrame:
    """Which declared limits the tables break."""
    groups = t("documents").groupBy(F.sha2("text", 256)).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") - 1).alias("duplicates"), F.sum("n").alias("valid"))
    fatal = t("labels").agg(F.count_if(F.col("quality") == 0).alias("fatal"))
    missing = datasets.orphans(t("documents"), t("labels"), "doc_id").agg(F.count(F.lit(1)).alias("missing"))
    report = groups.crossJoin(fatal).crossJoin(missing).withColumn("syntax", F.lit(0))  # three one-row reports
    return report.select(F.array_join(datasets.violations(report), ",").alias("violations"))


@query("doc_id bigint", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_keep_first(t: Tables) -> DataFrame:
    """The first row of each group of equal texts."""
    return tables.keep_first(t("documents").select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"], ["doc_id"])


@query(
    "split string, before bigint, removed bigint, after bigint",
    """SELECT lang AS split, count(*) AS before, count(*) FILTER (doc_id <> f) AS removed, count(*) FILTER (doc_id = f) AS after
        FROM (SELECT lang, doc_id, min(doc_id) OVER (PARTITION BY text) AS f
        FROM documents) GROUP BY lang""",
)
def dedupe_summary(t: Tables) -> DataFrame:
    """What deduplication takes from each part."""
    return datasets.dedupe_summary(t("documents").select("doc_id", F.col("lang").alias("split"), F.sha2("text", 256).alias("digest")), ["digest"], "doc_id")


@query(
    "lang string, source string, samples bigint",
    f"""SELECT lang, source, count(*) AS samples FROM documents WHERE {_split_sql('CAST(doc_id AS VARCHAR)')} = 'train'
        GROUP BY lang, source""",
)
def contamination(t: Tables) -> DataFrame:
    """How many training rows each (language, source) holds."""
    splits = t("documents").select("doc_id", score.assign_split(F.col("doc_id").cast("string"), datasets.SPLIT_SALT).alias("split"))
    return datasets.training_pages(t("documents"), splits, "doc_id", ["lang", "source"])


@query(
    "doc_id bigint, lang string, source string, mark string",
    """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 AND quality IS NOT NULL THEN 'q' || quality ELSE lang END AS lang, source,
        CASE WHEN d.doc_id % 3 = 0 AND quality IS NOT NULL THEN 't' || toxic END AS mark
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def provenance_update(t: Tables) -> DataFrame:
    """UPDATE from a patch, only where a condition holds, adding a column."""
    patch = t("labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("lang"), F.concat(F.lit("t"), "toxic").alias("mark"))
    return tables.update(t("documents"), patch, ["doc_id"], F.col("doc_id") % 3 == 0)


@query(
    "side string, doc_id bigint, reason string",
    """SELECT CASE WHEN l.doc_id IS NULL THEN 'source' ELSE 'quarantine' END AS side, d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'toxic' END AS reason
        FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id""",
)
def quarantine_move(t: Tables) -> DataFrame:
    """MOVE of some rows to another table with a reason."""
    docs = t("documents").select("doc_id", "lang")
    left, moved = tables.move(docs, docs.limit(0).withColumn("reason", F.lit("")), t("labels").where("toxic = 1"), ["doc_id"], {"reason": F.lit("toxic")}, ["lang"])
    return left.select(F.lit("source").alias("side"), "doc_id", F.lit(None).cast("string").alias("reason")).union(moved.select(F.lit("quarantine"), "doc_id", "reason"))


@query(
    "c_custkey bigint, c_acctbal double, c_mktsegment string",
    """SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0
        UNION ALL SELECT c_custkey, -1.0, 'NEW' FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT 900000000 + c_custkey, -1.0, 'NEW' FROM customer
        WHERE c_custkey % 4 = 0""",
)
def table_upsert(t: Tables) -> DataFrame:
    """UPSERT: rows with known keys are replaced, others added."""
    c = t("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    old = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit(-1.0).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return tables.transaction(c, lambda d: tables.upsert(d, old, ["c_custkey"]), lambda d: tables.insert(d, old.withColumn("c_custkey", F.col("c_custkey") + 900000000)))
