"""Layout queries over boxes made from lineitem, lines made from documents, and turns as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillforge.functions import geometry as gm
from quillforge.functions import text as tx
from quillforge.operators import ctc
from quillforge.operators import layout as lo
from quillforge.operators import order_model as om
from quillforge.operators import regions as rg
from quillforge.plans.registry import query
from quillforge.sources import sinks
from quillforge.tables import table


def boxes(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """A box for each order line on the page of its order; ``shift`` moves them as a predictor might."""
    k = F.col("l_partkey")
    x, y = F.pmod(k * 37, F.lit(600)) + shift, F.pmod(k * 91, F.lit(800)) + shift
    kind = F.get(F.array(*map(F.lit, gm.TYPES)), (k % 5).cast("int"))
    role = F.when(F.col("l_suppkey") % 7 == 0, "header").when(F.col("l_suppkey") % 7 == 1, "footer")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("ord"), x.alias("x"), y.alias("y"), (F.pmod(F.col("l_suppkey") * 13, F.lit(300)) + 20).alias("w"), (F.col("l_quantity").cast("long") * 5 + 10).alias("h"), F.lit(1000).alias("page_width"), F.lit(1400).alias("page_height"), kind.alias("type"), role.alias("role"))


_BOX = "SELECT l_orderkey AS page, l_linenumber::BIGINT AS ord, (l_partkey * 37) % 600 + {0} AS x, (l_partkey * 91) % 800 + {0} AS y, (l_suppkey * 13) % 300 + 20 AS w, l_quantity::BIGINT * 5 + 10 AS h, ['heading', 'paragraph', 'list', 'table', 'image'][l_partkey % 5 + 1] AS type, CASE l_suppkey % 7 WHEN 0 THEN 'header' WHEN 1 THEN 'footer' END AS role FROM lineitem"
_IOU = f"""a AS ({_BOX.format(0)}), b AS ({_BOX.format(12)}),
i AS (SELECT a.page, a.ord AS ref, b.ord AS pred, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter, a.w * a.h + b.w * b.h AS areas FROM a JOIN b USING (page)),
m AS (SELECT page, ref, pred, inter / (areas - inter)::DOUBLE AS iou FROM i WHERE inter > 0 AND inter / (areas - inter)::DOUBLE >= 0.3)"""


@query(f"WITH {_IOU} SELECT page, ref, pred, round(iou, 6) AS iou FROM m")
def q_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.candidates(boxes(spark, sf_dir), boxes(spark, sf_dir, 12), 0.3).withColumn("iou", F.round("iou", 6))


#: Greedy one-to-one matching as a recursion over a page's candidates in order.
_GREEDY = f"""{_IOU}, c AS (SELECT page, ref, pred, iou, row_number() OVER (PARTITION BY page ORDER BY iou DESC, ref DESC, pred DESC) AS i FROM m),
g AS (SELECT DISTINCT page, 0::BIGINT AS i, []::BIGINT[] AS rs, []::BIGINT[] AS ps, NULL::BIGINT AS ref, NULL::BIGINT AS pred, NULL::DOUBLE AS iou, false AS ok FROM c
UNION ALL SELECT c.page, c.i, CASE WHEN list_contains(rs, c.ref) OR list_contains(ps, c.pred) THEN rs ELSE list_append(rs, c.ref) END, CASE WHEN list_contains(rs, c.ref) OR list_contains(ps, c.pred) THEN ps ELSE list_append(ps, c.pred) END,
c.ref, c.pred, c.iou, NOT (list_contains(rs, c.ref) OR list_contains(ps, c.pred)) FROM g JOIN c ON c.page = g.page AND c.i = g.i + 1), best AS (SELECT page, ref, pred, iou FROM g WHERE ok)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT page, ref, pred, round(iou, 6) AS iou FROM best")
def q_iou_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.greedy(lo.candidates(boxes(spark, sf_dir), boxes(spark, sf_dir, 12), 0.3)).withColumn("iou", F.round("iou", 6))


_RATIO = "CASE WHEN {1} = 0 THEN ({0} = 0)::INT::DOUBLE ELSE {0} / {1}::DOUBLE END"


@query(
    f"""WITH RECURSIVE {_GREEDY}, z AS (SELECT page, count(*) AS n FROM a GROUP BY page), o AS (SELECT l.page, count(*) AS pairs, count(*) FILTER (WHERE l.pred < r.pred) AS hits FROM best l JOIN best r ON l.page = r.page AND l.ref < r.ref GROUP BY l.page),
h AS (SELECT page, count(*) AS matched, sum(iou) AS total FROM best GROUP BY page), f AS (SELECT z.page, z.n AS n_ref, z.n AS n_pred, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total, coalesce(pairs, 0) AS pairs, coalesce(hits, 0) AS hits FROM z LEFT JOIN h ON h.page = z.page LEFT JOIN o ON o.page = z.page)
SELECT page, n_ref, n_pred, matched, round({_RATIO.format('matched', 'n_pred')}, 6) AS precision, round({_RATIO.format('matched', 'n_ref')}, 6) AS recall, round({_RATIO.format('matched', 'n_ref')}, 6) AS f1,
round({_RATIO.format('total', 'matched')}, 6) AS mean_iou, round({_RATIO.format('hits', 'pairs')}, 6) AS order_accuracy FROM f"""
)
def q_layout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides have the same boxes, one of them moved, so precision, recall and F1 agree."""
    ref, pred = boxes(spark, sf_dir).drop("type"), boxes(spark, sf_dir, 12).drop("type")
    got = lo.layout_metrics(ref, pred, lo.greedy(lo.candidates(ref, pred, 0.3)))
    return got.select("page", "n_ref", "n_pred", "matched", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_iou", "order_accuracy")))


_SIDE = ["{0}.x / 1000.0::DOUBLE", "{0}.y / 1400.0::DOUBLE", "({0}.x + {0}.w) / 1000.0::DOUBLE", "({0}.y + {0}.h) / 1400.0::DOUBLE", "({0}.x + {0}.w / 2.0::DOUBLE) / 1000", "({0}.y + {0}.h / 2.0::DOUBLE) / 1400"]
_SIDE += ["{0}.w / 1000.0::DOUBLE", "{0}.h / 1400.0::DOUBLE", "{0}.w * {0}.h / 1400000.0::DOUBLE", *(f"({{0}}.type = '{t}')::INT::DOUBLE" for t in gm.TYPES), *(f"coalesce({{0}}.role = '{r}', false)::INT::DOUBLE" for r in gm.ROLES)]
_ALONG = "greatest(0, least(a.{0} + a.{1}, b.{0} + b.{1}) - greatest(a.{0}, b.{0})) / least(a.{1}, b.{1})::DOUBLE"
_BOTH = [x.format("a") for x in _SIDE] + [x.format("b") for x in _SIDE] + [f"{_SIDE[i].format('b')} - {_SIDE[i].format('a')}" for i in (4, 5, 6, 7)] + [_ALONG.format("x", "w"), _ALONG.format("y", "h")]


@query(f"WITH t AS ({_BOX.format(0)}) SELECT a.page, a.ord AS a, b.ord AS b, (a.ord < b.ord)::INT AS label, {', '.join(f'round({e} + 1e-9::DOUBLE, 5) + 0.0 AS f{i}' for i, e in enumerate(_BOTH))} FROM t a JOIN t b ON a.page = b.page AND a.ord <> b.ord")
def q_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 38 features of every ordered pair."""
    return lo.ordered_pairs(boxes(spark, sf_dir)).select("page", "a", "b", "label", *((F.round(F.get("features", F.lit(i)) + 1e-9, 5) + 0.0).alias(f"f{i}") for i in range(38)))


@query(
    f"""WITH t AS ({_BOX.format(0)}), p AS (SELECT a.page, a.ord AS a, b.ord AS b, CASE WHEN (a.y, a.x) < (b.y, b.x) THEN 0.75::DOUBLE WHEN (a.y, a.x) = (b.y, b.x) THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS f FROM t a JOIN t b ON a.page = b.page AND a.ord <> b.ord),
s AS (SELECT p.page, p.a AS block, sum((p.f + 1 - q.f) / 2) AS score FROM p JOIN p q ON p.page = q.page AND p.a = q.b AND p.b = q.a GROUP BY ALL)
SELECT page, block, row_number() OVER (PARTITION BY page ORDER BY score DESC, block) AS place FROM s"""
)
def q_borda_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise preferences (here: by place on the page) summed into an order."""
    t = boxes(spark, sf_dir)
    a, b = t.select("page", F.col("ord").alias("a"), F.struct("y", "x").alias("pa")), t.select("page", F.col("ord").alias("b"), F.struct("y", "x").alias("pb"))
    pairs = a.join(b, "page").where("a <> b")
    forward = F.when(F.col("pa") < F.col("pb"), 0.75).when(F.col("pa") == F.col("pb"), 0.5).otherwise(0.25)
    return lo.borda(pairs.withColumn("f", forward), F.col("f")).select("page", "block", F.col("place").cast("long").alias("place"))


@query()
def q_learned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's boxes in the order that a model learned from all pages' boxes by their places, summed up from its chances."""
    t = boxes(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("page").orderBy("y", "x", "w", "h", "type", "role")).cast("long"))
    pairs = lo.ordered_pairs(t)
    model = om.fit(pairs, epochs=4, batches=6, rate=0.02, hidden=16)
    return lo.borda(om.forward(pairs, model), F.col("p")).select("page", "block", F.col("place").cast("long").alias("place"))


@query(
    r"""WITH l AS (SELECT source AS doc, doc_id AS page, string_split(text, chr(10)) AS parts FROM documents WHERE text <> ''),
b AS (SELECT doc, page, 'header' AS band, trim(parts[1]) AS text FROM l UNION ALL SELECT doc, page, 'footer', trim(parts[-1]) FROM l),
n AS (SELECT doc, count(DISTINCT page) AS pages FROM b GROUP BY doc), c AS (SELECT doc, text, band, count(DISTINCT page) AS on_pages FROM b GROUP BY ALL)
SELECT doc, text, band AS role, on_pages FROM c JOIN n USING (doc) WHERE pages >= 2 AND on_pages >= greatest(2, floor(pages * 0.02 + 0.999999)) QUALIFY row_number() OVER (PARTITION BY doc, text ORDER BY band <> 'header') = 1"""
)
def q_header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last lines of documents as bands, a source as a document of many pages."""
    parts = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.split("text", "\n", -1).alias("p"))
    bands = F.array(F.struct(F.lit("header").alias("band"), F.trim(F.element_at("p", 1)).alias("text")), F.struct(F.lit("footer").alias("band"), F.trim(F.element_at("p", -1)).alias("text")))
    return lo.repeated_bands(parts.select("doc", "page", F.explode(bands).alias("b")).select("doc", "page", "b.band", "b.text"), 0.02)


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS lines, min(turn * 20) AS y, max(turn * 20 + 18) - min(turn * 20) AS h, max(length(text)) AS w FROM conversations GROUP BY conv_id")
def q_paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines, a conversation as a paragraph."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text", F.lit(1.0).alias("confidence"), F.lit(0).alias("x"), (F.col("turn") * 20).alias("y"), F.char_length("text").cast("long").alias("w"), F.lit(18).cast("long").alias("h"))
    return lo.paragraphs(rows, ["conv_id"]).select("conv_id", "text", "lines", "y", "h", "w")


@query(
    f"""WITH t AS (SELECT *, x + w / 2.0::DOUBLE AS centre FROM ({_BOX.format(0)})), g AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY centre, ord, x, y, w, h) AS i, count(*) OVER (PARTITION BY page) AS n FROM t),
l AS (SELECT *, centre - lag(centre) OVER (PARTITION BY page ORDER BY i) AS gap FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap DESC NULLS LAST, i) AS k FROM l)
SELECT page, ord, sum((gap IS NOT NULL AND k <= 2)::INT) OVER (PARTITION BY page ORDER BY i)::BIGINT AS column FROM k WHERE n >= 3"""
)
def q_column_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.column_groups(boxes(spark, sf_dir), 3)


@query(
    """WITH p AS (SELECT l_suppkey AS key, l_partkey % 500 AS pos, l_orderkey, l_linenumber FROM lineitem), o AS (SELECT key, pos, coalesce((pos - lag(pos) OVER (PARTITION BY key ORDER BY pos) > 2)::INT, 0) AS opens FROM (SELECT DISTINCT key, pos FROM p)),
r AS (SELECT key, pos, sum(opens) OVER (PARTITION BY key ORDER BY pos)::BIGINT AS run FROM o) SELECT key, run, round_even(avg(pos), 0)::BIGINT AS pos, count(*) AS n FROM r GROUP BY key, run"""
)
def q_collapse_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers of a supplier as line positions."""
    pos = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), (F.col("l_partkey") % 500).alias("pos")).distinct()
    return lo.collapsed(pos)


@query(
    f"""WITH RECURSIVE t AS (SELECT page, ord, y + h / 2.0::DOUBLE AS c, h::DOUBLE AS h, row_number() OVER (PARTITION BY page ORDER BY y, ord, h) AS i FROM ({_BOX.format(0)})),
r AS (SELECT DISTINCT page, 0::BIGINT AS i, NULL::BIGINT AS ord, -1::BIGINT AS "row", []::DOUBLE[] AS cs, []::DOUBLE[] AS hs FROM t
UNION ALL SELECT t.page, t.i, t.ord, CASE WHEN len(cs) > 0 AND abs(c - list_median(cs)) <= 0.6 * list_median(hs) THEN r."row" ELSE r."row" + 1 END, CASE WHEN len(cs) > 0 AND abs(c - list_median(cs)) <= 0.6 * list_median(hs) THEN list_append(cs, c) ELSE [c] END,
CASE WHEN len(cs) > 0 AND abs(c - list_median(cs)) <= 0.6 * list_median(hs) THEN list_append(hs, t.h) ELSE [t.h] END FROM r JOIN t ON t.page = r.page AND t.i = r.i + 1) SELECT page, ord, "row" FROM r WHERE i > 0"""
)
def q_row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lo.row_clusters(boxes(spark, sf_dir))


@query()
def q_region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.merged_regions(boxes(spark, sf_dir))


@query()
def q_diagram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.merged_diagrams(boxes(spark, sf_dir))


@query()
def q_line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rg.merged_lines(boxes(spark, sf_dir), 40)


_IDS = "s AS (SELECT user_id, list(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id)"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user in order as label ids, views as blanks."""
    label = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", label.alias("label"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(ordered.alias("s")).select("user_id", F.transform("s", lambda x: x["label"]).alias("ids"))


@query(f"WITH {_IDS}, e AS (SELECT user_id, unnest(ids) AS a, unnest(list_prepend(NULL, ids[:-2])) AS b, unnest(range(len(ids))) AS i FROM s) SELECT user_id, coalesce(string_agg(a, ',' ORDER BY i) FILTER (WHERE a <> 0 AND (b IS NULL OR a <> b)), '') AS labels FROM e GROUP BY user_id")
def q_ctc_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("user_id", F.array_join(ctc.collapse(F.col("ids")), ",").alias("labels"))


@query(f"WITH {_IDS}, e AS (SELECT user_id, unnest(ids) AS a, unnest(list_prepend(NULL, ids[:-2])) AS b FROM s) SELECT user_id, (count(*) + count(*) FILTER (WHERE a = b))::BIGINT AS steps FROM e GROUP BY user_id")
def q_ctc_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir).select("user_id", ctc.needed_steps(F.col("ids")).cast("long").alias("steps"))


def _lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lattice a user, made from the values of all events in order: four labels and a blank."""
    step = F.array(*(F.log(F.lit(0.05) + F.abs(F.sin(F.col("value") * (k + 1)))) for k in range(5)))
    norm = F.transform(step, lambda v: v - F.log(F.aggregate(F.transform(step, lambda u: F.exp(u)), F.lit(0.0), lambda a, b: a + b)))
    rows = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", norm.alias("p")))).alias("s"))
    return rows.select("user_id", F.transform("s", lambda x: x["p"]).alias("lattice"))


@query()
def q_ctc_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam search over the lattices of all users."""
    decoded = _lattices(spark, sf_dir).select("user_id", ctc.beam_decode()(F.col("lattice")).alias("d"))
    return decoded.select("user_id", F.array_join("d.labels", ",").alias("labels"), F.round("d.log_prob", 6).alias("log_prob"))


@query()
def q_ctc_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a model of label pairs, counted over the event types of all users (views left out)."""
    sequences = _sequences(spark, sf_dir).select(F.filter("ids", lambda i: i > 0).alias("ids"))
    model = ctc.LabelModel.collect(ctc.label_counts(sequences, 2), 2, 4)
    decoded = _lattices(spark, sf_dir).select("user_id", ctc.beam_decode(10, model=model, weight=0.5, bonus=0.2)(F.col("lattice")).alias("d"))
    return decoded.select("user_id", F.array_join("d.labels", ",").alias("labels"), *(F.round(f"d.{c}", 6).alias(c) for c in ("log_prob", "ranking", "model_log_prob")))


_TEXT = "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS text FROM conversations GROUP BY conv_id"


@query(_TEXT)
def q_plain_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page joined by line ends; empty ones are skipped."""
    rows = table(spark, sf_dir, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), "text"))).alias("blocks"))
    return rows.select("conv_id", sinks.plain_text(F.array(F.col("blocks"))).alias("text"))


@query(
    r"""SELECT conv_id, regexp_replace(string_agg(CASE role WHEN 'system' THEN '# ' || replace(text, chr(10), ' ') WHEN 'user' THEN '## ' || replace(text, chr(10), ' ') ELSE text END, chr(10) || chr(10) ORDER BY turn), '^\s+|\s+$', '', 'g') || chr(10) AS markdown FROM conversations WHERE text <> '' GROUP BY conv_id"""
)
def q_markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System turns as first-level headings, user turns as second-level ones, others as paragraphs."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)
    block = F.struct("turn", F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("type"), level.alias("level"), "text", F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("string").alias("list_style"))
    rows = table(spark, sf_dir, "conversations").where("text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return rows.select("conv_id", sinks.markdown(F.col("blocks")).alias("markdown"))


@query(r"SELECT doc_id, len(regexp_extract_all(replace(text, chr(10), ''), '\P{M}\p{M}*|^\p{M}+')) AS n_clusters FROM documents WHERE text IS NOT NULL")
def q_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(tx.clusters(F.regexp_replace("text", "\n", ""))).cast("long").alias("n_clusters"))
