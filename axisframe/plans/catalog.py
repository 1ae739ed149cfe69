"""Registered queries over the driver's tables, with their DuckDB counterparts.

The tables stand in for a store: obs = orders, var = part, X = lineitem quantities (with duplicate
coordinates to add up), layers = prices and discounts, obsm = embeddings, uns = event properties. Rows are
positioned by the key itself, so no global numbering is needed to read them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, predicate, typing
from ..operators import axis, concat, joins, matrix, reshape
from ..sources.store import Frame, Matrix, Store, describe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Frame:
    """Orders as obs: pos and name from the key."""
    t = table(spark, sf_dir, "orders")
    return Frame(t.select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("name"), "o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"))


def parts(spark: SparkSession, sf_dir: str) -> Frame:
    """Parts as var."""
    t = table(spark, sf_dir, "part")
    return Frame(t.select(F.col("p_partkey").alias("pos"), F.col("p_partkey").cast("string").alias("name"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


def quantities(spark: SparkSession, sf_dir: str, value: str = "l_quantity") -> Matrix:
    """Lineitem as entries; sides are bounds of the keys."""
    t = table(spark, sf_dir, "lineitem")
    return Matrix(t.select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col(value).alias("v")), (1 << 40, 1 << 40), "float64")


def virtual(spark: SparkSession, sf_dir: str) -> Store:
    return Store(orders(spark, sf_dir), parts(spark, sf_dir), {"X": quantities(spark, sf_dir), "layers/discount": quantities(spark, sf_dir, "l_discount")})


_KEPT = "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')"


@query(
    "subset_query",
    f"""SELECT l_partkey AS part, CAST(count(*) AS BIGINT) AS n_entries, CAST(sum(q) AS DOUBLE) AS total
        FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem
              WHERE l_orderkey IN ({_KEPT}) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)
              GROUP BY 1, 2) GROUP BY 1""",
)
def subset_query(spark, sf_dir):
    """Subset on both axes by the selection language; entries and totals per kept variable."""
    rows = axis.select(orders(spark, sf_dir), "o_totalprice > 100000 and o_orderpriority in (1-URGENT, 2-HIGH)")
    columns = axis.select(parts(spark, sf_dir), "p_size < 10")
    x = quantities(spark, sf_dir).data
    x = x.join(rows, F.col("i") == F.col("pos"), "left_semi").join(columns, F.col("j") == F.col("pos"), "left_semi")
    return matrix.summed(x).groupBy(F.col("j").alias("part")).agg(F.count("*").alias("n_entries"), F.sum("v").alias("total"))


@query(
    "subset_renumbered",
    f"""WITH o AS (SELECT o_orderkey AS pos, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM ({_KEPT})),
        p AS (SELECT p_partkey AS pos, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part WHERE p_brand = 'Brand#3')
        SELECT o.n::BIGINT AS i, p.n::BIGINT AS j, l_quantity AS v FROM lineitem JOIN o ON l_orderkey = o.pos JOIN p ON l_partkey = p.pos""",
)
def subset_renumbered(spark, sf_dir):
    """The whole subset: maps of both axes, numbered anew, and the entries on them."""
    rows = axis.row_map(axis.select(orders(spark, sf_dir), "o_totalprice > 100000 and o_orderpriority in (1-URGENT, 2-HIGH)"))
    columns = axis.row_map(axis.select(parts(spark, sf_dir), "p_brand == Brand#3"))
    return matrix.taken(quantities(spark, sf_dir), rows, columns, (0, 0)).data


@query("filter_name_list", "SELECT o_orderkey AS pos FROM orders WHERE o_orderkey % 7 = 3")
def filter_name_list(spark, sf_dir):
    """Rows whose name is in a list: a semi-join."""
    o = orders(spark, sf_dir)
    wanted = o.data.where("pos % 7 = 3").select("name").union(spark.createDataFrame([("no such name",)], "name string"))
    return axis.select(o, wanted=wanted)


@query("names_absent", "SELECT DISTINCT CAST(l_orderkey + 10 AS VARCHAR) AS name FROM lineitem WHERE l_orderkey + 10 NOT IN (SELECT o_orderkey FROM orders)")
def names_absent(spark, sf_dir):
    """Names of a list that the axis lacks: an anti-join."""
    wanted = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 10).cast("string").alias("name"))
    return axis.absent(orders(spark, sf_dir), wanted)


_LABELLED = """SELECT d.doc_id AS pos, l.quality, CAST(CASE WHEN l.toxic = 1 THEN NULL ELSE l.quality + 0.1 END AS FLOAT) AS score,
               CASE WHEN l.quality IS NOT NULL THEN d.source END AS tag, l.toxic = 1 AS flag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _labelled(spark, sf_dir) -> DataFrame:
    """Documents with labels: columns with gaps of each kind."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    rows = d.select("doc_id", "source").join(l, F.col("doc_id") == F.col("id"), "left")
    score = F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.col("quality") + F.lit(0.1)).cast("float")
    return rows.select(F.col("doc_id").alias("pos"), "quality", score.alias("score"), F.when(F.col("quality").isNotNull(), F.col("source")).alias("tag"), (F.col("toxic") == 1).alias("flag"))


#: Expressions over (quality int, score float, tag text, flag boolean), all with gaps, and the same in SQL.
_PREDICATES = [
    ("quality == 1", "coalesce(quality = 1, false)"),
    ("quality != 1", "NOT coalesce(quality = 1, false)"),
    ("quality == nan", "quality IS NULL"),
    ("score <= 0.1", "coalesce(score <= CAST(0.1 AS FLOAT), false)"),
    ("score > 0.1 or flag == true", "coalesce(score > CAST(0.1 AS FLOAT), false) OR coalesce(flag, false)"),
    ("tag in (src1, src2, '')", "coalesce(tag, '') IN ('src1', 'src2', '')"),
    ("tag not in (src1, src2)", "NOT coalesce(tag, '') IN ('src1', 'src2')"),
    ("not (flag == false and quality < 1.5)", "NOT (coalesce(NOT flag, false) AND coalesce(quality < 1.5, false))"),
    ("quality == 0.5 or quality >= 9999999999", "false"),
    ("quality < 9999999999", "quality IS NOT NULL"),
    ("flag < 1", "coalesce(NOT flag, false)"),
]


@query(
    "predicate_logic",
    " UNION ALL ".join(f"SELECT {k} AS expression, count(*)::BIGINT AS n, coalesce(sum(pos), 0)::BIGINT AS total FROM ({_LABELLED}) WHERE {s}" for k, (_, s) in enumerate(_PREDICATES)),
)
def predicate_logic(spark, sf_dir):
    """Two-valued logic over columns with gaps: all expressions in one scan and one aggregate."""
    rows = _labelled(spark, sf_dir)
    hits = [predicate.to_column(predicate.parse(e), rows.schema) for e, _ in _PREDICATES]
    flags = rows.select("pos", F.posexplode(F.array(*hits)).alias("expression", "hit"))
    return flags.groupBy("expression").agg(F.count_if("hit").alias("n"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("pos"))), F.lit(0)).alias("total"))


@query(
    "text_as_number",
    "SELECT count(*)::BIGINT AS n FROM (SELECT regexp_extract(p_type, '[0-9]+') AS t FROM part UNION ALL SELECT CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT '1d' FROM region) WHERE TRY_CAST(CASE WHEN regexp_matches(t, '^[0-9.]+$') THEN t END AS DOUBLE) > 25",
)
def text_as_number(spark, sf_dir):
    """Ordering on a text column parses its entries; what cannot be parsed does not match."""
    p = table(spark, sf_dir, "part")
    t = p.select(F.regexp_extract("p_type", "[0-9]+", 0).alias("t")).union(p.select(F.col("p_size").cast("string"))).union(table(spark, sf_dir, "region").select(F.lit("1d")))
    return predicate.where(t, "t > 25").agg(F.count("*").alias("n"))


@query("sum_duplicates", "SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def sum_duplicates(spark, sf_dir):
    """Entries of one coordinate add up."""
    return matrix.summed(quantities(spark, sf_dir).data)


@query(
    "transpose_pointers",
    """WITH e AS (SELECT l_partkey AS j, l_orderkey AS i, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
       c AS (SELECT p_partkey AS pos, count(i) AS n FROM part LEFT JOIN e ON p_partkey = j GROUP BY 1)
       SELECT pos, coalesce(sum(n) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n FROM c""",
)
def transpose_pointers(spark, sf_dir):
    """Column pointers of the matrix: where each column's entries begin in column order."""
    x = quantities(spark, sf_dir)
    n = table(spark, sf_dir, "part").count()
    return matrix.pointers(Matrix(matrix.summed(x.data), (x.shape[0], n), "float64"), "j")


@query("row_counts", "SELECT l_orderkey AS i, count(*)::BIGINT AS n, sum(abs(l_quantity)) AS magnitude FROM lineitem GROUP BY 1")
def row_counts(spark, sf_dir):
    """Entries and magnitude per row."""
    return matrix.counts_per(quantities(spark, sf_dir).data, "i")


@query(
    "cast_report",
    """SELECT 'l_quantity' AS layer, count(*)::BIGINT AS total, count(*) FILTER (WHERE CAST(trunc(l_quantity) AS DOUBLE) <> l_quantity)::BIGINT AS changed FROM lineitem
       UNION ALL SELECT 'l_discount', count(*), count(*) FILTER (WHERE CAST(trunc(l_discount) AS DOUBLE) <> l_discount) FROM lineitem
       UNION ALL SELECT 'l_extendedprice', count(*), count(*) FILTER (WHERE CAST(trunc(l_extendedprice) AS DOUBLE) <> l_extendedprice) FROM lineitem""",
)
def cast_report(spark, sf_dir):
    """What a cast to int32 would change, per layer."""
    found = []
    for layer in ("l_quantity", "l_discount", "l_extendedprice"):
        r = matrix.cast_report(quantities(spark, sf_dir, layer), "int32")
        found.append((layer, r.total, r.changed))
    return spark.createDataFrame(found, "layer string, total long, changed long")


@query(
    "cast_float32",
    "SELECT l_orderkey AS i, l_linenumber AS k, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS v, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) <> l_discount AS changed FROM lineitem",
)
def cast_float32(spark, sf_dir):
    """Values narrowed to float32, and whether they return."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("k"), F.col("l_discount").alias("x"))
    v = matrix.cast_value(F.col("x"), "float64", "float32").cast("double")
    return t.select("i", "k", v.alias("v"), (v != F.col("x")).alias("changed"))


@query(
    "densify_rows",
    """SELECT o_orderkey AS i, p.k::INTEGER AS j, coalesce(e.v, 0) AS v FROM orders CROSS JOIN (SELECT unnest(range(8)) AS k) p
       LEFT JOIN (SELECT l_orderkey, l_partkey % 8 AS c, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) e ON e.l_orderkey = o_orderkey AND e.c = p.k""",
)
def densify_rows(spark, sf_dir):
    """A sparse matrix as dense rows, all of them: absent cells are zeros, rows without entries too. Parts are folded into eight
    columns."""
    x = quantities(spark, sf_dir).data.select("i", F.pmod("j", F.lit(8)).alias("j"), "v")
    dense = matrix.densified(Matrix(x, (table(spark, sf_dir, "orders").count(), 8), "float64")).data
    return dense.select("i", F.posexplode("values").alias("j", "v"))


@query("sparsify_embeddings", "SELECT vec_id AS i, (k - 1)::BIGINT AS j, e AS v FROM (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(embedding) AS e FROM embeddings) WHERE e > 0.2")
def sparsify_embeddings(spark, sf_dir):
    """A dense matrix as entries; here those above a threshold, which is zeroed below it first."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.transform("embedding", lambda x: F.when(x > F.lit(0.2), x).otherwise(F.lit(0.0).cast("float"))).alias("values"))
    return matrix.sparsified(Matrix(rows, (0, 64), "float32", "dense")).data


@query(
    "pack_rows",
    """SELECT l_orderkey AS i, count(*)::BIGINT AS n, sum(l_partkey * k)::BIGINT AS places FROM
       (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) GROUP BY 1""",
)
def pack_rows(spark, sf_dir):
    """Packed rows: indices sorted within each row."""
    x = quantities(spark, sf_dir)
    rows = matrix.packed(Matrix(matrix.summed(x.data), x.shape, x.dtype))
    places = F.aggregate(F.sequence(F.lit(1), F.size("indices")), F.lit(0).cast("long"), lambda a, k: a + k * F.element_at("indices", k))
    return rows.select("i", F.size("indices").cast("long").alias("n"), places.alias("places"))


@query("split_groups", "SELECT event_type AS label, count(*)::BIGINT AS n, min(event_id) AS first FROM events GROUP BY 1")
def split_groups(spark, sf_dir):
    """Labels of a column with their rows and first appearance."""
    return axis.groups(table(spark, sf_dir, "events").withColumn("pos", F.col("event_id")), "event_type")


@query(
    "split_missing_label",
    f"SELECT tag AS label, count(*)::BIGINT AS n, min(pos) AS first FROM (SELECT pos, CASE WHEN tag = 'src3' THEN '' ELSE tag END AS tag FROM ({_LABELLED})) GROUP BY 1",
)
def split_missing_label(spark, sf_dir):
    """The missing label is a group of its own, apart from the empty text."""
    rows = _labelled(spark, sf_dir).withColumn("tag", F.when(F.col("tag") == "src3", "").otherwise(F.col("tag")))
    return axis.groups(rows, "tag")


@query(
    "split_entries",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS n FROM orders)
       SELECT o_orderstatus AS label, n::BIGINT AS i, l_partkey AS j, l_quantity AS v FROM lineitem JOIN o ON l_orderkey = o_orderkey""",
)
def split_entries(spark, sf_dir):
    """Each entry with the output it goes to and its row there, for all outputs in one pass."""
    found, rows = reshape.split_entries(virtual(spark, sf_dir), "o_orderstatus")
    labels = spark.createDataFrame([(k, p.label) for k, p in enumerate(found)], "part int, label string")
    return rows.join(F.broadcast(labels), "part").select("label", "i", "j", "v")


def _yearly(spark, sf_dir, year: int) -> Store:
    """Orders of one year with the parts they have; obs keep different columns each year."""
    o = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == year)
    l = table(spark, sf_dir, "lineitem")
    x = l.join(o.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    columns = ["o_totalprice", "o_orderstatus"] if year % 2 else ["o_totalprice", "o_custkey"]
    obs = axis.renumbered(o.select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("name"), *columns))
    used = x.select(F.col("l_partkey").alias("pos")).distinct()
    var = axis.renumbered(used.select("pos", F.col("pos").cast("string").alias("name")))
    maps = obs.select("pos", "new_pos"), var.select("pos", "new_pos")
    base = Matrix(x.select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")), (0, 0), "float64")
    entries = matrix.taken(base, *maps, (obs.count(), var.count()))
    numbered = lambda d: d.drop("pos").withColumnRenamed("new_pos", "pos")
    return Store(Frame(numbered(obs).select("pos", "name", *columns)), Frame(numbered(var).select("pos", "name")), {"X": entries})


def _concat_sql(join: str) -> str:
    names_of = {"inner": "(SELECT name FROM a INTERSECT SELECT name FROM b)", "outer": "(SELECT name FROM a UNION SELECT name FROM b)"}[join]
    order = {"inner": "(SELECT DISTINCT l_partkey FROM x WHERE y = 1995 AND CAST(l_partkey AS VARCHAR) IN (SELECT name FROM n)) t", "outer": "n"}[join]
    place = {"inner": "CAST(l_partkey AS VARCHAR) AS name, row_number() OVER (ORDER BY l_partkey) - 1 AS j", "outer": "name, row_number() OVER (ORDER BY name) - 1 AS j"}[join]
    return f"""WITH x AS (SELECT year(o_orderdate) AS y, l_orderkey, l_partkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) IN (1995, 1996)),
      a AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS name FROM x WHERE y = 1995), b AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS name FROM x WHERE y = 1996),
      n AS {names_of}, v AS (SELECT {place} FROM {order}),
      o AS (SELECT o_orderkey, row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) - 1 AS i FROM orders WHERE year(o_orderdate) IN (1995, 1996))
      SELECT o.i::BIGINT AS i, v.j::BIGINT AS j, l_quantity AS v FROM x JOIN o ON l_orderkey = o_orderkey JOIN v ON CAST(l_partkey AS VARCHAR) = v.name"""


def _concat(spark, sf_dir, join: str) -> Store:
    return concat.concat({"1995": _yearly(spark, sf_dir, 1995), "1996": _yearly(spark, sf_dir, 1996)}, join=join, label="year", merge="first")


@query("concat_inner", _concat_sql("inner"))
def concat_inner(spark, sf_dir):
    """Two inputs aligned on the variables both have."""
    return _concat(spark, sf_dir, "inner").matrices["X"].data


@query("concat_outer", _concat_sql("outer"))
def concat_outer(spark, sf_dir):
    """Two inputs aligned on the variables either has, in sorted order."""
    return _concat(spark, sf_dir, "outer").matrices["X"].data


@query(
    "concat_obs",
    """SELECT row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) - 1 AS pos, CAST(o_orderkey AS VARCHAR) AS name, o_totalprice,
       CASE WHEN year(o_orderdate) = 1995 THEN o_orderstatus END AS o_orderstatus, CASE WHEN year(o_orderdate) = 1996 THEN CAST(o_custkey AS DOUBLE) ELSE -1 END AS o_custkey,
       CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE year(o_orderdate) IN (1995, 1996)""",
)
def concat_obs(spark, sf_dir):
    """The joined obs table: whole numbers that one input lacks come as floats with NaN, shown as -1 here."""
    rows = _concat(spark, sf_dir, "outer").obs.data
    return rows.select("pos", "name", "o_totalprice", "o_orderstatus", F.when(F.isnan("o_custkey"), -1.0).otherwise(F.col("o_custkey")).alias("o_custkey"), "year")


@query(
    "align_inner",
    "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS name, l_partkey AS pos FROM lineitem WHERE l_linenumber = 1 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 4)",
)
def align_inner(spark, sf_dir):
    """Names that both axes have, in the first one's order."""
    l = table(spark, sf_dir, "lineitem")
    part = lambda k: l.where(F.col("l_linenumber") == k).select(F.col("l_partkey").cast("string").alias("name"), F.col("l_partkey").alias("pos")).distinct()
    return axis.shared_names([part(1), part(4)])


@query(
    "checked_join",
    """SELECT c_custkey AS pos, c_name, coalesce(n, 0)::BIGINT AS n_orders, coalesce(total, 0) AS total FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice * 100 AS BIGINT)) AS DOUBLE) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def checked_join(spark, sf_dir):
    """A table joined to an axis after its keys were checked; gaps are filled."""
    frame = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("name"), "c_name")
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count("*").alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("total"))
    out, _ = joins.checked_left(frame, t, "key", fills={"n_orders": 0, "total": 0.0})
    return out.drop("name")


@query(
    "join_counts",
    """SELECT count(*) FILTER (WHERE o_custkey IS NOT NULL)::BIGINT AS matched, 0::BIGINT AS extra, count(*) FILTER (WHERE o_custkey IS NULL)::BIGINT AS missing
       FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey""",
)
def join_counts(spark, sf_dir):
    """How a table of keys meets an axis."""
    frame = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    m = joins.check(frame, table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("key")).distinct(), "key")
    return spark.createDataFrame([(m.matched, m.extra, m.missing)], "matched long, extra long, missing long")


@query(
    "unique_names",
    "SELECT p_partkey AS pos, CASE WHEN n = 0 THEN p_name ELSE p_name || '-' || n END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)",
)
def unique_names(spark, sf_dir):
    """Repeated names made distinct by number."""
    return names.unique_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name")))


@query("file_stems", r"SELECT DISTINCT p_type AS label, regexp_replace(regexp_replace(trim(p_type), '[/\\]|\s+', '_', 'g'), '[^A-Za-z0-9_.-]+', '', 'g') AS stem FROM part")
def file_stems(spark, sf_dir):
    """Labels as parts of file names."""
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("label")).distinct().withColumn("stem", names.file_stem_column(F.col("label")))


@query(
    "natural_order",
    "SELECT p_brand AS label, row_number() OVER (ORDER BY CAST(replace(p_brand, 'Brand#', '') AS INTEGER))::BIGINT - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)",
)
def natural_order(spark, sf_dir):
    """Category codes in natural order: Brand#2 before Brand#10."""
    frame = axis.categorised(parts(spark, sf_dir), "p_brand")
    labels = frame.categories["p_brand"].labels
    return frame.data.select(F.col("p_brand").alias("label"), axis.codes(F.col("p_brand"), labels).cast("long").alias("code")).distinct()


@query("prune_categories", "SELECT DISTINCT o_orderpriority AS label FROM orders WHERE o_totalprice > 400000")
def prune_categories(spark, sf_dir):
    """Labels that a selection leaves in use."""
    o = axis.categorised(orders(spark, sf_dir), "o_orderpriority")
    kept = axis.take(o, axis.row_map(axis.select(o, "o_totalprice > 400000")))
    return spark.createDataFrame([(x,) for x in kept.categories["o_orderpriority"].labels], "label string")


@query(
    "merged_categories",
    """SELECT label, row_number() OVER (ORDER BY CAST(replace(label, 'Brand#', '') AS INTEGER))::BIGINT - 1 AS code FROM (
       SELECT DISTINCT p_brand AS label FROM part WHERE p_size < 20 UNION SELECT DISTINCT p_brand FROM part WHERE p_size > 30)""",
)
def merged_categories(spark, sf_dir):
    """The categories of two inputs joined; a first input whose order covers all keeps it, and natural order is that order here."""
    p = parts(spark, sf_dir)
    cats = [axis.categorised(Frame(p.data.where(w)), "p_brand").categories["p_brand"] for w in ("p_size < 20", "p_size > 30")]
    merged = concat.merged_categories(cats)
    return spark.createDataFrame(list(enumerate(merged.labels)), "code long, label string")


@query(
    "infer_types",
    """SELECT 'p_size' AS name, 'int' AS kind UNION ALL SELECT 'p_retailprice', 'float' UNION ALL SELECT 'p_name', 'text' UNION ALL SELECT 'big', 'bool' UNION ALL SELECT 'mixed', 'text'""",
)
def infer_types(spark, sf_dir):
    """What columns of text hold, in one aggregate."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_size").cast("string").alias("p_size"), F.col("p_retailprice").cast("string").alias("p_retailprice"), "p_name", F.when(F.col("p_size") > 25, "True").otherwise("false").alias("big"), F.when(F.col("p_size") > 25, "True").otherwise("1").alias("mixed"))
    found = typing.infer(rows, rows.columns)
    return spark.createDataFrame([(k, v.kind) for k, v in found.items()], "name string, kind string")


@query("json_values", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(spark, sf_dir):
    """Members of nested metadata."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("number_text", "SELECT l_orderkey AS i, l_linenumber AS k, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity FROM lineitem")
def number_text(spark, sf_dir):
    """Whole floats as whole numbers in text output."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("k"), typing.number_text(F.col("l_quantity"), "double").alias("quantity"))


@query("head_rows", "SELECT o_orderkey AS pos, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25")
def head_rows(spark, sf_dir):
    """The first rows of a frame, of named columns."""
    return orders(spark, sf_dir).data.select("pos", "o_orderstatus").orderBy("pos").limit(25)


@query(
    "merge_same",
    "SELECT p_partkey AS pos, p_brand, p_size FROM part",
)
def merge_same(spark, sf_dir):
    """var columns of two equal inputs under the strategy that keeps what is the same; one differing column goes."""
    p = parts(spark, sf_dir).data
    one = p.select(F.col("pos") - 1, "name", "p_brand", "p_size", "p_retailprice").toDF("pos", "name", "p_brand", "p_size", "p_retailprice")
    two = one.withColumn("p_retailprice", F.col("p_retailprice") + 1)
    obs = lambda n: Frame(spark.range(n).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("name")))
    out = concat.concat({"a": Store(obs(2), Frame(one)), "b": Store(obs(3), Frame(two))}, join="outer", merge="same")
    return out.var.data.select((F.col("name").cast("long")).alias("pos"), *[c for c in out.var.columns])


@query(
    "graph_remap",
    "SELECT (l_suppkey - 1)::BIGINT AS i, s_nationkey::BIGINT AS j, count(*)::BIGINT AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 40 GROUP BY 1, 2",
)
def graph_remap(spark, sf_dir):
    """Pairwise entries with their ends mapped."""
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("i"))
    s = table(spark, sf_dir, "supplier")
    own = s.select(F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") - 1).alias("new_pos"))
    edges = l.select("i", F.col("i").alias("j"), F.lit(1).alias("v"))
    both = joins.remapped_graph(edges, own)
    labels = s.select((F.col("s_suppkey") - 1).alias("code"), F.col("s_nationkey").cast("long").alias("label"))
    out = joins.looked_up(both, "j", labels)
    return out.groupBy("i", F.col("label").alias("j")).agg(F.count("*").alias("v"))


@query("view_manifest", "SELECT 'obs' AS axis, count(*)::BIGINT AS n, 4::BIGINT AS columns FROM orders UNION ALL SELECT 'var', count(*), 5 FROM part")
def view_manifest(spark, sf_dir):
    """What a store says of its axes; Parquet answers from its footers."""
    found = [(e["path"], *e["shape"]) for e in describe(virtual(spark, sf_dir)) if e["path"] in ("obs", "var")]
    return spark.createDataFrame(found, "axis string, n long, columns long")


@query(
    "digest_equal",
    """WITH x AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), y AS (SELECT i, j, CASE WHEN i = 1 THEN v + 1 ELSE v END AS v FROM x)
       SELECT (SELECT count(*) FROM (FROM x EXCEPT FROM x)) = 0 AS same_order, (SELECT count(*) FROM (FROM x EXCEPT FROM y)) = 0 AS same_values,
       (SELECT max(9007199254740992 + i) = max(9007199254740992 + i + 1) FROM x) AS same_large""",
)
def digest_equal(spark, sf_dir):
    """Content digests tell equal matrices from others whatever the order of their entries, also by whole numbers that one
    float stands for."""
    x = matrix.summed(quantities(spark, sf_dir).data)
    a, b = matrix.digest(x), matrix.digest(x.orderBy("v"))
    c = matrix.digest(x.withColumn("v", F.when((F.col("i") == 1), F.col("v") + 1).otherwise(F.col("v"))))
    large = [matrix.digest(x.withColumn("v", F.lit(1 << 53) + F.col("i") + k)) for k in (0, 1)]
    return spark.createDataFrame([(a == b, a == c, large[0] == large[1])], "same_order boolean, same_values boolean, same_large boolean")


@query(
    "dense_column_take",
    "SELECT vec_id AS i, embedding[5] AS a, embedding[1] AS b FROM embeddings",
)
def dense_column_take(spark, sf_dir):
    """Columns of a dense matrix taken in another order."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("values"))
    order = spark.createDataFrame([(4, 0), (0, 1)], "pos long, new_pos long")
    out = matrix.taken(Matrix(e, (0, 64), "float32", "dense"), None, order, (0, 2)).data
    return out.select("i", F.get("values", F.lit(0)).alias("a"), F.get("values", F.lit(1)).alias("b"))


@query(
    "rank_appearance",
    "SELECT o_orderpriority AS label, row_number() OVER (ORDER BY min(o_orderkey))::BIGINT - 1 AS rank FROM orders GROUP BY 1",
)
def rank_appearance(spark, sf_dir):
    """Labels ranked by first appearance."""
    g = axis.groups(orders(spark, sf_dir).data, "o_orderpriority")
    return g.select("label", (F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("rank"))  # one row a label




from . import roundtrips  # noqa: E402, F401
