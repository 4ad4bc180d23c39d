"""Secret scans with multipart linking, by DataFrame expressions alone.

Each kind's matches are found with their places: splitting a text at a pattern gives what lies
between its matches, extracting gives the matches, and the running sum of both gives starts and
ends. Assignments, access identifiers and long hex runs are reported as they are. Weak parts --
account names, endpoints, bare mixed-character tokens -- mean little alone; all parts of a text
meet in an interval join: texts are cut into cells as wide as the scope, parts meet in
equal and neighbouring cells, and a weak part is reported if the parts that complement it lie
within the scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialize, text_or_empty

#: Base patterns (fixed values), by kind in the order that breaks ties.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Weak parts: an account's name, an endpoint, and a bare token of 20 characters or more.
IDENT = r"""(?i)(?:user(?:name)?|login|account|client_id|access_key(?:_id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}"""
ENDPOINT = r"""(?i)(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""
BARE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Characters within which parts belong together.
SCOPE = 300
KINDS = ("assign", "access", "hex", "ident", "endpoint", "bare")
BASE = 3  # so many of KINDS are reported wherever they match


def _pieces(text: Column, kind: int, pattern: str, good=None) -> Column:
    """Structs (rank, at, between, match, good) of a pattern's matches and the text before each.

    The last one holds what follows the last match and has no match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    marks = F.transform(found, lambda m: F.lit(True)) if good is None else good(found)
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda b: F.length(b)).alias("b"), F.transform(found, lambda m: F.length(m)).alias("m"), marks.alias("g"))
    return F.transform(zipped, lambda x, i: F.struct(F.lit(kind).alias("rank"), i.alias("at"), x["b"].alias("b"), x["m"].alias("m"), x["g"].alias("good")))


def _of_rank(rank: int):
    return lambda s: s["rank"] == rank


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) for every row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and then by the
    order of KINDS. Base spans always count. A weak span that overlaps none of an earlier kind is
    reported (and counted in ``n_linked``) if within ``scope`` characters of it lie: for an
    account's name or an endpoint, an assignment or hex run, or a bare token and the other of the
    two; for a bare token of upper and lower letters and digits, an access identifier, or an
    account's name and an endpoint. Null texts count as empty; repeated rows are scanned each;
    rows without spans have an empty ``spans``; other columns are ignored.
    """
    text = text_or_empty(text_column)
    sets = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    has = {
        "assign": sets & text.rlike(ASSIGN),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike(f"[0-9a-f]{{{HEX_LEAST},}}"),
        "ident": sets & text.rlike(IDENT),
        "endpoint": F.contains(text, F.lit("://")) & text.rlike(ENDPOINT),
    }
    has["bare"] = has["access"] | (has["ident"] & has["endpoint"])  # a bare token counts beside these alone
    values = lambda found: F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    mixed = lambda found: F.transform(found, lambda t: t.rlike("[A-Z]") & t.rlike("[a-z]") & t.rlike("[0-9]"))
    # runs of one class are maximal, so a least length in the pattern drops the same matches
    patterns = (ASSIGN, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", f"[0-9a-f]{{{HEX_LEAST},}}", IDENT, ENDPOINT, BARE)
    good = (values, None, None, None, None, mixed)
    none = F.array().cast("array<struct<rank:int,at:int,b:int,m:int,good:boolean>>")
    pieces = [F.when(has[k], _pieces(text, i, patterns[i], good[i])).otherwise(none) for i, k in enumerate(KINDS)]
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), F.concat(*pieces).alias("_pieces")))

    # places: the running sum of what lies between the matches and of the matches themselves
    each = rows.filter(F.size("_pieces") > 0).select("_row", F.inline("_pieces"))
    upto = Window.partitionBy("_row", "rank").orderBy("at")
    ends = each.withColumn("stop", F.sum(F.col("b") + F.coalesce("m", F.lit(0))).over(upto).cast("int"))
    spans = ends.filter(F.col("m").isNotNull() & F.col("good")).select("_row", "rank", (F.col("stop") - F.col("m")).alias("start"), "stop")

    # interval join: a weak part is in the cells it touches, any part in those its scope touches
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope).cast("int"), F.floor(high / scope).cast("int")))
    weak = spans.filter(F.col("rank") >= BASE).select("_row", "rank", "start", "stop", cells(F.col("start"), F.col("stop")).alias("cell"))
    near = spans.select("_row", F.col("rank").alias("r"), F.col("start").alias("s"), F.col("stop").alias("e"), cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("stop") + scope).alias("cell"))
    within = (F.col("s") - F.col("stop") <= scope) & (F.col("start") - F.col("e") <= scope)
    met = weak.join(near, ["_row", "cell"]).filter(within & ~((F.col("r") == F.col("rank")) & (F.col("s") == F.col("start"))))
    beside = {k: F.bool_or(F.col("r") == i) for i, k in enumerate(KINDS)}
    hidden = F.bool_or((F.col("r") < F.col("rank")) & (F.col("s") < F.col("stop")) & (F.col("start") < F.col("e")))
    about = met.groupBy("_row", "rank", "start", "stop").agg(hidden.alias("hidden"), *[v.alias(k) for k, v in beside.items()])
    strong = F.col("assign") | F.col("hex")
    complete = (
        F.when(F.col("rank") == KINDS.index("ident"), strong | (F.col("bare") & F.col("endpoint")))
        .when(F.col("rank") == KINDS.index("endpoint"), strong | (F.col("bare") & F.col("ident")))
        .otherwise(F.col("access") | (F.col("ident") & F.col("endpoint")))
    )
    linked = about.filter(complete & ~F.col("hidden")).select("_row", "rank", "start", "stop")

    reported = spans.filter(F.col("rank") < BASE).union(linked)
    by_row = reported.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "stop"))).alias("all"))
    names = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    joined = lambda found: F.array_join(F.transform(found, line), ",")
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:int,rank:int,stop:int>>"))
    out = rows.select("_row", "_id").join(by_row, "_row", "left").select(F.col("_id").alias(id_column), every.alias("every"))
    return out.select(
        id_column,
        *[F.size(F.filter("every", _of_rank(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE])],
        F.sha2(joined(F.filter("every", lambda s: s["rank"] < BASE)), 256).alias("base_sha256"),
        joined(F.col("every")).alias("spans"),
        F.size(F.filter("every", lambda s: s["rank"] >= BASE)).cast("long").alias("n_linked"),
    )


def _oracle() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = (ASSIGN, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}", f"[0-9a-f]{{{HEX_LEAST},}}", IDENT, ENDPOINT, BARE)
    kinds = []
    for i, p in enumerate(patterns):
        good = {0: f"list_transform(regexp_extract_all(t, {quoted(p)}, 2), lambda v: length(v) >= {ASSIGN_LEAST})", 5: "list_transform(m, lambda v: regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]'))"}
        kinds.append(
            f"SELECT r, {i} AS rank, unnest(range(1, len(m) + 1)) AS turn, unnest(b[1:len(m)]) AS b, unnest(m) AS m, unnest({good.get(i, 'list_transform(m, lambda v: true)')}) AS good "
            f"FROM (SELECT r, t, string_split_regex(t, {quoted(p)}) AS b, regexp_extract_all(t, {quoted(p)}) AS m FROM docs) WHERE len(m) > 0"
        )
    names = "['" + "', '".join(KINDS) + "']"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
pieces AS ({' UNION ALL '.join(kinds)}),
ends AS (SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY r, rank ORDER BY turn) AS stop FROM pieces),
spans AS (SELECT r, rank, (stop - length(m))::INT AS start, stop::INT AS stop FROM ends WHERE good),
about AS (
  SELECT w.r, w.rank, w.start, w.stop,
    bool_or(p.rank < w.rank AND p.start < w.stop AND w.start < p.stop) AS hidden,
    {', '.join(f'bool_or(p.rank = {i}) AS "{k}"' for i, k in enumerate(KINDS))}
  FROM spans w JOIN spans p ON w.r = p.r AND p.start - w.stop <= {SCOPE} AND w.start - p.stop <= {SCOPE} AND NOT (p.rank = w.rank AND p.start = w.start)
  WHERE w.rank >= {BASE} GROUP BY ALL),
reported AS (
  SELECT r, rank, start, stop FROM spans WHERE rank < {BASE}
  UNION ALL
  SELECT r, rank, start, stop FROM about WHERE NOT hidden AND CASE rank
    WHEN 3 THEN assign OR hex OR (bare AND endpoint) WHEN 4 THEN assign OR hex OR (bare AND ident) ELSE access OR (ident AND endpoint) END),
lines AS (SELECT *, {names}[rank + 1] || ':' || start || ':' || stop AS line FROM reported),
by_row AS (
  SELECT r, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h, count(*) FILTER (rank >= {BASE}) AS l,
    string_agg(line, ',' ORDER BY start, rank) FILTER (rank < {BASE}) AS base, string_agg(line, ',' ORDER BY start, rank) AS every
  FROM lines GROUP BY r)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(every, '') AS spans, coalesce(l, 0) AS n_linked
FROM docs d LEFT JOIN by_row USING (r)
"""


#: ``op5_secret_scan`` in DuckDB SQL.
ORACLE = _oracle()
