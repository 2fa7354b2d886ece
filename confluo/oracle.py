"""DuckDB SQL equivalent to each registered query (the correctness oracle).

Written independently of the Spark code: plain SQL over the same parquet
views.  Doubles are rounded only where the Spark query rounds too.
"""

from __future__ import annotations

# What the queries cover, stated again here.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
FENCE_TARGETS = [("events", ["value"]), ("documents", ["n_chars"]),
                 ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                               "l_extendedprice", "l_discount", "l_tax"])]
HISTOGRAM_TARGETS = [("lineitem", ["l_quantity"]), ("events", ["value"])]
TEXT_COLUMNS = {"part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
                "customer": ["c_name", "c_mktsegment"], "documents": ["text", "lang", "source"],
                "benchmark": ["text"], "conversations": ["role", "text"], "events": ["event_type", "props"]}
NORMALIZED_TEXT_COLUMNS = {"documents": ["text"], "benchmark": ["text"], "conversations": ["text"]}
SHAPE_TARGETS = [("part", ["p_brand"]), ("orders", ["o_orderpriority"]), ("customer", ["c_name"]), ("pages", ["url"])]
PCA_LINEITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
WIDE_COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"], "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"]}
WIDE_DOUBLES = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax"}
SESSION_FILES = {"customer": "customer list.csv", "supplier": "supplier_combined.csv", "part": "part.csv"}
SESSION_COLUMNS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
                   "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
                   "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]}

# Column types of the driver tables used by the type-dependent oracles.
TYPES = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
}
COMBINED = [("name", "string"), ("balance", "string"), ("category", "string")]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


HOMOGENIZE_SQL = """
SELECT coalesce(c_name, '') AS name, coalesce(CAST(c_acctbal AS VARCHAR), '') AS balance,
       coalesce(c_mktsegment, '') AS category FROM customer
UNION ALL
SELECT coalesce(s_name, ''), coalesce(CAST(s_acctbal AS VARCHAR), ''), '' FROM supplier
UNION ALL
SELECT concat_ws(' ', p_brand, p_name), coalesce(CAST(p_retailprice AS VARCHAR), ''),
       coalesce(p_type, '') FROM part
"""

ALIGN_SQL = "SELECT * FROM customer UNION ALL BY NAME SELECT * FROM supplier"


def _missing(c: str, t: str) -> str:
    if t == "string":
        return f"({c} IS NULL OR coalesce(isnan(try_cast({c} AS DOUBLE)), false) OR {c} = '')"
    if t == "double":
        return f"({c} IS NULL OR isnan({c}))"
    return f"({c} IS NULL)"


def null_profile_sql(source: str, cols: list[tuple[str, str]]) -> str:
    parts = [f"SELECT {_q(c)} AS \"column\", CAST(count(*) FILTER (WHERE {_missing(c, t)}) AS BIGINT) AS nulls "
             f"FROM u" for c, t in cols]
    return f"WITH u AS ({source}) SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE nulls > 0"


def castable_sql(label: str, source: str, cols: list[tuple[str, str]]) -> str:
    parts = []
    for c, _ in cols:
        n = f"CAST(count(try_cast(CAST({c} AS VARCHAR) AS DOUBLE)) AS BIGINT)"
        parts.append(f"SELECT {_q(label)} AS \"table\", {_q(c)} AS \"column\", {n} AS n_castable, "
                     f"{n} > 0 AS is_numeric FROM ({source})")
    return " UNION ALL ".join(parts)


def _fence_select(t: str, c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return (f"SELECT {_q(t)} AS \"table\", {_q(c)} AS \"column\", q1, q3, "
            f"q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower, q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper "
            f"FROM (SELECT quantile_disc({v}, 0.25) AS q1, quantile_disc({v}, 0.75) AS q3 "
            f"FROM {t} WHERE {c} IS NOT NULL AND NOT isnan({v}))")


def fences_sql() -> str:
    return " UNION ALL ".join(_fence_select(t, c) for t, cols in FENCE_TARGETS for c in cols)


def outlier_report_sql() -> str:
    parts = []
    for t, cols in FENCE_TARGETS:
        for c in cols:
            v = f"CAST({c} AS DOUBLE)"
            parts.append(f"SELECT f.*, (SELECT CAST(count(*) AS BIGINT) FROM {t} "
                         f"WHERE {v} < f.lower OR {v} > f.upper) AS n_outliers FROM ({_fence_select(t, c)}) f")
    return " UNION ALL ".join(parts)


def outliers_rows_sql() -> str:
    return (f"SELECT e.* FROM events e, ({_fence_select('events', 'value')}) f "
            f"WHERE CAST(e.value AS DOUBLE) < f.lower OR CAST(e.value AS DOUBLE) > f.upper")


def histogram_sql(values: str, label: str = 't AS "table", ') -> str:
    """numpy.histogram: a value belongs to the last of 30 bins whose left edge
    it reaches; the edges are low + k * width, the right end is closed.
    ``values``: a query of ``t, c, v``; null, NaN and infinities have no bin."""
    return f"""
WITH good AS (SELECT * FROM ({values}) WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)),
any_v AS (SELECT * FROM ({values}) WHERE v IS NOT NULL AND NOT isnan(v)),
f AS (SELECT t, c, quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3 FROM any_v GROUP BY t, c),
s AS (SELECT t, c, 'all' AS series, v FROM good
      UNION ALL
      SELECT good.t, good.c, 'outliers', v FROM good JOIN f ON good.t = f.t AND good.c = f.c
      WHERE v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1)),
ends AS (SELECT t, c, series, min(v) - (min(v) = max(v))::INT * 0.5::DOUBLE AS lo,
                max(v) + (min(v) = max(v))::INT * 0.5::DOUBLE AS hi FROM s GROUP BY t, c, series),
edges AS (SELECT t, c, series, list_transform(range(30), lambda k: k::DOUBLE * ((hi - lo) / 30) + lo) AS e FROM ends),
binned AS (SELECT s.t, s.c, s.series, len(list_filter(e, lambda x: x <= v)) - 1 AS bin
           FROM s JOIN edges ON s.t = edges.t AND s.c = edges.c AND s.series = edges.series)
SELECT {label}c AS "column", series, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM binned GROUP BY t, c, series, bin
"""


def _cells(targets) -> str:
    return " UNION ALL ".join(f"SELECT {_q(t)} AS t, {_q(c)} AS c, CAST({c} AS DOUBLE) AS v FROM {t}"
                              for t, cols in targets for c in cols)


WITH_INFINITY = """SELECT 'events' AS t, 'value' AS c, CASE WHEN event_id % 97 = 0 THEN 'Infinity'::DOUBLE
  WHEN event_id % 101 = 0 THEN '-Infinity'::DOUBLE WHEN event_id % 103 = 0 THEN 'NaN'::DOUBLE ELSE value END AS v FROM events"""
COMBINED_BALANCE = f"SELECT 'c' AS t, 'balance' AS c, try_cast(balance AS DOUBLE) AS v FROM ({HOMOGENIZE_SQL})"


NORMALIZE = ("trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')),"
             " '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))")
NORMALIZE_KEEP_NULL = ("trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')),"
                       " '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))")


def _java_text(x: str) -> str:
    """A double as Java writes it: with an exponent below 0.001 and from 10 million on."""
    plain = f"CAST(abs({x}) AS VARCHAR)"
    whole, part = f"split_part(split_part({plain}, 'e', 1), '.', 1)", f"split_part(split_part({plain}, 'e', 1), '.', 2)"
    exponent = (f"(coalesce(try_cast(split_part({plain}, 'e', 2) AS INTEGER), 0) + length({whole}) - 1"
                f" - length({whole} || {part}) + length(ltrim({whole} || {part}, '0')))")
    digits = f"trim({whole} || {part}, '0')"
    return (f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN isnan({x}) THEN 'NaN' WHEN isinf({x}) THEN 'Infinity'"
            f" WHEN {x} = 0 OR abs({x}) >= 0.001 AND abs({x}) < 10000000 THEN {plain}"
            f" ELSE {digits}[1] || '.' || coalesce(nullif({digits}[2:], ''), '0') || 'E' || {exponent} END")


def tfidf_sql(columns: dict[str, list[str]], normalize: bool, threshold: float = 0.8,
              names: dict[str, str] | None = None, doubles: set[str] = frozenset()) -> str:
    """``columns``: by table, in the order of the tables' (or ``names``') places.
    ``doubles``: those to be written as Java does."""
    cells = []
    for i, (t, cols) in enumerate(columns.items()):
        for c in cols:
            v = _java_text(c) if c in doubles else f"CAST({c} AS VARCHAR)"
            v = NORMALIZE.format(x=v) if normalize else v
            cells.append(f"SELECT {i} AS tidx, {_q((names or {}).get(t, t))} AS tname, {_q(c)} AS cname, {v} AS value FROM {t}")
    # a term in one of two documents weighs ln((1 + 2) / (1 + 1)) + 1, a shared one 1
    w = "pow(ln(3 / 2.0) + 1, 2)"
    sim = (f"g.dot / (sqrt(g.sa + CAST({w} AS DOUBLE) * (ta.ss - g.sa)) * "
           f"sqrt(g.sb + CAST({w} AS DOUBLE) * (tb.ss - g.sb)))")
    return f"""
WITH cells AS ({' UNION ALL '.join(cells)}),
tok AS (SELECT tidx, tname, cname, unnest(regexp_extract_all(lower(value), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token
        FROM cells WHERE value IS NOT NULL),
tf AS (SELECT tidx, tname, cname, token, count(*) AS tf FROM tok GROUP BY tidx, tname, cname, token),
tot AS (SELECT tname, cname, CAST(sum(tf * tf) AS DOUBLE) AS ss FROM tf GROUP BY tname, cname),
g AS (SELECT a.tname AS df1_name, a.cname AS column_df1, b.tname AS df2_name, b.cname AS column_df2,
             CAST(sum(a.tf * b.tf) AS DOUBLE) AS dot, CAST(sum(a.tf * a.tf) AS DOUBLE) AS sa,
             CAST(sum(b.tf * b.tf) AS DOUBLE) AS sb
      FROM tf a JOIN tf b ON a.token = b.token AND a.tidx < b.tidx
      GROUP BY a.tname, a.cname, b.tname, b.cname)
SELECT g.column_df1, g.column_df2, round({sim}, 6) AS similarity, g.df1_name, g.df2_name
FROM g JOIN tot ta ON ta.tname = g.df1_name AND ta.cname = g.column_df1
       JOIN tot tb ON tb.tname = g.df2_name AND tb.cname = g.column_df2
WHERE {sim} > {threshold}
"""


def _lcs(a: str, b: str) -> str:
    return (f"list_reduce(string_split({a}, ''), lambda p, ca: list_reduce(range(1, length({b}) + 1), "
            f"lambda acc, j: list_append(acc, CASE WHEN {b}[j] = ca THEN p[j] + 1 "
            f"ELSE greatest(p[j + 1], acc[-1]) END), [CAST(0 AS BIGINT)]), "
            f"list_resize([CAST(0 AS BIGINT)], length({b}) + 1, CAST(0 AS BIGINT)))[-1]")


def _key(x: str) -> str:
    return (f"array_to_string(list_sort(list_filter(string_split(trim(lower(regexp_replace("
            f"regexp_replace({x}, '[\\x{{80}}-\\x{{FF}}]', '', 'g'), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'))), ' '), "
            f"lambda x: x <> '')), ' ')")


def catalogue_sql() -> str:
    names = ", ".join(_q(t) for t in TABLES)
    return (f"SELECT file, CAST(dense_rank() OVER (ORDER BY file) - 1 AS INTEGER) AS file_idx, ordinal, column_name "
            f"FROM (SELECT DISTINCT table_name AS file, CAST(ordinal_position AS INTEGER) AS ordinal, column_name "
            f"FROM information_schema.columns WHERE table_name IN ({names}))")


def session_catalogue_sql() -> str:
    """The files of the session in name order, with their columns."""
    rows = [(f, i, j + 1, c) for i, (f, t) in enumerate(sorted((f, t) for t, f in SESSION_FILES.items()))
            for j, c in enumerate(SESSION_COLUMNS[t])]
    values = ", ".join(f"({_q(f)}, {i}, {j}, {_q(c)})" for f, i, j, c in rows)
    return (f"SELECT file, CAST(file_idx AS INTEGER) AS file_idx, CAST(ordinal AS INTEGER) AS ordinal, column_name "
            f"FROM (VALUES {values}) x(file, file_idx, ordinal, column_name)")


def _score(a: str, b: str) -> str:
    return (f"CASE WHEN {a} = {b} THEN 100 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 "
            f"ELSE CAST(round_even(CAST(100 AS DOUBLE) * (CAST(2 * {_lcs(a, b)} AS DOUBLE) / "
            f"(length({a}) + length({b}))), 0) AS INTEGER) END")


def groups_sql(threshold: int = 80) -> str:
    """Greedy groups as a sequential walk: a recursive CTE carries the used names."""
    return f"""
WITH RECURSIVE
cat AS ({catalogue_sql()}),
pos AS (SELECT column_name AS name, CAST(file_idx AS BIGINT) * 4294967296 + ordinal AS pos FROM cat),
firsts AS (SELECT name, min(pos) AS pos FROM pos GROUP BY name),
keyed AS (SELECT name, pos, {_key('name')} AS key FROM firsts),
sim AS (SELECT * FROM (SELECT l.name AS a, r.name AS b, {_score('l.key', 'r.key')} AS score
                       FROM keyed l JOIN keyed r ON l.name <> r.name) WHERE score >= {threshold}),
ordered AS (SELECT name, row_number() OVER (ORDER BY pos) AS i FROM firsts),
nbrs AS (SELECT o.i, o.name, coalesce(list(s.b) FILTER (WHERE s.b IS NOT NULL), []) AS sims
         FROM ordered o LEFT JOIN sim s ON s.a = o.name GROUP BY o.i, o.name),
walk(i, used, leaders) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
    UNION ALL
    SELECT n.i,
           CASE WHEN list_contains(w.used, n.name) OR len(n.sims) = 0 THEN w.used
                ELSE list_concat(w.used, n.sims, [n.name]) END,
           CASE WHEN list_contains(w.used, n.name) OR len(n.sims) = 0 THEN w.leaders
                ELSE list_append(w.leaders, n.name) END
    FROM walk w JOIN nbrs n ON n.i = w.i + 1),
leaders AS (SELECT unnest(leaders) AS leader FROM (SELECT leaders FROM walk ORDER BY i DESC LIMIT 1)),
members AS (SELECT l.leader, p.name AS member, s.score, p.pos
            FROM leaders l JOIN sim s ON s.a = l.leader JOIN pos p ON p.name = s.b)
SELECT leader, CAST(row_number() OVER (PARTITION BY leader ORDER BY score DESC, pos) - 1 AS INTEGER) AS member_rank,
       member FROM members
UNION ALL
SELECT l.leader, CAST(count(m.member) AS INTEGER), l.leader FROM leaders l LEFT JOIN members m ON m.leader = l.leader
GROUP BY l.leader
"""


def _pairs_cte(threshold: int, catalogue: str | None = None) -> str:
    score = _score("l.key", "r.key")
    return f"""
cat AS ({catalogue or catalogue_sql()}),
keyed AS (SELECT *, {_key('column_name')} AS key FROM cat),
scored AS (SELECT l.file AS file_l, l.file_idx AS file_idx_l, l.ordinal AS ordinal_l, l.column_name AS column_l,
                  r.file AS file_r, r.file_idx AS file_idx_r, r.ordinal AS ordinal_r, r.column_name AS column_r,
                  {score} AS score
           FROM keyed l JOIN keyed r
             ON l.file_idx < r.file_idx OR (l.file_idx = r.file_idx AND l.ordinal < r.ordinal)),
pairs AS (SELECT * FROM scored WHERE score >= {threshold})"""


def name_pairs_sql() -> str:
    return f"WITH {_pairs_cte(80)} SELECT file_l, column_l, file_r, column_r, score FROM pairs"


def name_recommendations_sql(threshold: int = 90, catalogue: str | None = None) -> str:
    grp = "file_idx_x, ordinal_x, file_idx_y"
    seq = "file_idx_x DESC, file_idx_y DESC, ordinal_x, kind_rank"
    return f"""
WITH {_pairs_cte(threshold, catalogue)},
d0 AS (SELECT file_l AS file_x, file_idx_l AS file_idx_x, ordinal_l AS ordinal_x, column_l AS column_x,
              file_r AS file_y, file_idx_r AS file_idx_y, ordinal_r AS ordinal_y, column_r AS column_y, score FROM pairs
       UNION ALL
       SELECT file_r, file_idx_r, ordinal_r, column_r, file_l, file_idx_l, ordinal_l, column_l, score FROM pairs),
d AS (SELECT * FROM d0 WHERE file_idx_x >= file_idx_y),
diff AS (SELECT *, row_number() OVER (PARTITION BY {grp} ORDER BY score DESC, ordinal_y) - 1 AS rank,
                CASE WHEN count(*) OVER (PARTITION BY {grp}) = 1 THEN 'single' ELSE 'multi' END AS kind,
                0 AS kind_rank
         FROM d WHERE column_x <> column_y),
eq AS (SELECT *, 0 AS rank, 'equal' AS kind, 1 AS kind_rank FROM d
       WHERE column_x = column_y AND file_idx_x <> file_idx_y),
ev AS (SELECT * FROM diff UNION ALL BY NAME SELECT * FROM eq),
heads AS (SELECT * FROM ev WHERE rank = 0),
singles AS (SELECT * FROM (SELECT *, first_value(column_x) OVER (
               PARTITION BY least(column_x, column_y), greatest(column_x, column_y) ORDER BY {seq}) AS fx
             FROM heads WHERE kind = 'single') WHERE column_x = fx),
kept AS (SELECT file_idx_x, ordinal_x, file_idx_y, kind, kind_rank FROM singles
         UNION ALL SELECT file_idx_x, ordinal_x, file_idx_y, kind, kind_rank FROM heads WHERE kind <> 'single'),
recs AS (SELECT *, row_number() OVER (ORDER BY {seq}) - 1 AS rec_no FROM kept)
SELECT CAST(recs.rec_no AS BIGINT) AS rec_no,
       CASE WHEN ev.file_idx_x = ev.file_idx_y OR ev.kind = 'equal' THEN ev.file_x || '_' ELSE ev.file_x END
         AS file_left,
       ev.column_x AS "column", ev.file_y AS file_right, ev.kind, CAST(ev.rank AS INTEGER) AS rank,
       ev.column_y AS similar, CAST(ev.score AS INTEGER) AS score
FROM ev JOIN recs ON ev.file_idx_x = recs.file_idx_x AND ev.ordinal_x = recs.ordinal_x
                 AND ev.file_idx_y = recs.file_idx_y AND ev.kind = recs.kind
"""


def _shape(x: str) -> str:
    return (f"regexp_replace(regexp_replace({x}, '\\p{{L}}+', '[a-zA-Z]', 'g'), "
            f"'\\p{{N}}+', '[0-9]', 'g')")


def shapes_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {_q(t)} AS \"table\", {_q(c)} AS \"column\", {_shape(c)} AS shape, CAST(count(*) AS BIGINT) AS n "
        f"FROM {t} WHERE {c} IS NOT NULL GROUP BY {_shape(c)}"
        for t, cols in SHAPE_TARGETS for c in cols)


def conformance_sql() -> str:
    return f"""
WITH s AS ({shapes_sql()}),
tot AS (SELECT "table", "column", CAST(sum(n) AS BIGINT) AS n_values FROM s GROUP BY "table", "column"),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY n DESC, shape) AS rn
                     FROM s) WHERE rn = 1)
SELECT d."table", d."column", d.shape, tot.n_values, d.n AS n_match,
       round(CAST(d.n AS DOUBLE) / tot.n_values, 6) AS match_rate
FROM d JOIN tot ON d."table" = tot."table" AND d."column" = tot."column"
"""


def correlation_sql(table: str, cols: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return " UNION ALL ".join(
        f"SELECT {_q(a)} AS column_a, {_q(b)} AS column_b, "
        f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 9) AS corr FROM {table}" for a, b in pairs)


FINAL_REPORT_OUTLIERS_SQL = f"""
WITH c AS ({HOMOGENIZE_SQL}),
v AS (SELECT 'balance' AS "column", try_cast(balance AS DOUBLE) AS v FROM c),
f AS (SELECT "column", quantile_disc(v, 0.25) AS q1, quantile_disc(v, 0.75) AS q3
      FROM v WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY "column"),
b AS (SELECT "column", q1, q3, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower,
             q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper FROM f)
SELECT b."column", q1, q3, lower, upper,
       CAST(count(*) FILTER (WHERE v.v < lower OR v.v > upper) AS BIGINT) AS n_outliers
FROM b JOIN v ON v."column" = b."column" GROUP BY b."column", q1, q3, lower, upper
"""


EMBEDDING_SIZE = 64
PCA_MATRIX = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM lineitem"
                                for i, a in enumerate(PCA_LINEITEM, 1) for j, b in enumerate(PCA_LINEITEM, 1))


def pca_curve_sql(n: int, matrix: str, more: str = "", sweeps: int = 9) -> str:
    """Eigenvalues of a symmetric matrix ``(i, j, r)`` by Jacobi rotations, in
    rounds of disjoint pairs (a round-robin), as shares of their sum."""
    at = lambda r, c: f"m[({r} - 1) * {n} + {c}]"
    return f"""
WITH RECURSIVE {more}
first AS (SELECT list(r ORDER BY i, j) AS m FROM ({matrix})),
seats AS (SELECT t, p, CASE WHEN p = 1 THEN 1 ELSE (p - 2 + t) % {n - 1} + 2 END AS who
          FROM (SELECT unnest(range({n - 1})) AS t), (SELECT unnest(range(1, {n} + 1)) AS p)),
pairs AS (SELECT a.t, least(a.who, b.who) AS p, greatest(a.who, b.who) AS q
          FROM seats a JOIN seats b ON a.t = b.t AND a.p + b.p = {n + 1} AND a.p < b.p),
partner AS (SELECT t, list(o ORDER BY w) AS other FROM (SELECT t, p AS w, q AS o FROM pairs UNION ALL SELECT t, q, p FROM pairs) GROUP BY t),
steps(k, m) AS (
  SELECT 0, m FROM first
  UNION ALL
  SELECT k + 1, list_transform(range({n} * {n}), lambda e:
      c[e // {n} + 1] * c[e % {n} + 1] * m[e + 1]
    + s[e // {n} + 1] * c[e % {n} + 1] * m[(other[e // {n} + 1] - 1) * {n} + e % {n} + 1]
    + c[e // {n} + 1] * s[e % {n} + 1] * m[e // {n} * {n} + other[e % {n} + 1]]
    + s[e // {n} + 1] * s[e % {n} + 1] * m[(other[e // {n} + 1] - 1) * {n} + other[e % {n} + 1]])
  FROM (
    SELECT k, m, other, list_transform(a, lambda x: cos(x)) AS c,
      list_transform(range(1, {n} + 1), lambda i: CASE WHEN i < other[i] THEN -sin(a[i]) ELSE sin(a[i]) END) AS s
    FROM (
      SELECT k, m, other, list_transform(range(1, {n} + 1), lambda i: 0.5::DOUBLE * atan2(
        2 * {at('least(i, other[i])', 'greatest(i, other[i])')},
        {at('greatest(i, other[i])', 'greatest(i, other[i])')} - {at('least(i, other[i])', 'least(i, other[i])')})) AS a
      FROM steps JOIN partner ON t = k % {n - 1} WHERE k < {sweeps * (n - 1)}))),
roots AS (SELECT unnest(list_transform(range(1, {n} + 1), lambda i: {at('i', 'i')})) AS v FROM (SELECT m FROM steps ORDER BY k DESC LIMIT 1))
SELECT row_number() OVER w::INTEGER AS k, round(v / sum(v) OVER (), 6) AS explained_variance,
  round(sum(v) OVER w / sum(v) OVER (), 6) AS cumulative_variance
FROM roots WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)
"""


def factored_sql(threshold: int = 90) -> str:
    """From the expanded recommendations and the catalogue: a row a column and
    right file; names of several files."""
    return f"""
WITH cat AS ({catalogue_sql()}),
places AS (SELECT column_name, string_agg(file, ',' ORDER BY file_idx) AS files, count(DISTINCT file) AS n FROM cat GROUP BY column_name),
recs AS ({name_recommendations_sql(threshold)})
SELECT "column", kind, file_right, files, "similar" FROM (
  SELECT "column", kind, file_right, string_agg("similar", ',' ORDER BY rank) AS "similar" FROM (
    SELECT DISTINCT "column", kind, file_right, rank, "similar" FROM recs WHERE kind <> 'equal') GROUP BY "column", kind, file_right)
JOIN places ON column_name = "column"
UNION ALL
SELECT column_name, 'equal', NULL, files, column_name FROM places WHERE n > 1
"""


SESSION_HOMOGENIZE_SQL = HOMOGENIZE_SQL.replace(
    "AS category FROM customer", "AS category, 'customer list.csv' AS source_file FROM customer").replace(
    "'' FROM supplier", "'', 'supplier_combined.csv' FROM supplier").replace(
    "coalesce(p_type, '') FROM part", "coalesce(p_type, ''), 'part.csv' FROM part")
_BY_FILE = {t: SESSION_COLUMNS[t] for t in sorted(SESSION_FILES, key=SESSION_FILES.get)}

ORACLE = {
    "iqr_fences_approx": " UNION ALL ".join(
        f"SELECT 'lineitem' AS \"table\", {_q(c)} AS \"column\", {p}::DOUBLE AS p, count(*) > 0 AS within FROM lineitem"
        for c in FENCE_TARGETS[2][1] for p in (0.25, 0.75)),
    # rows of a single file come in their order
    "sample_bernoulli": "SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER () - 1 AS i FROM lineitem) "
        "WHERE substr(md5('274|lineitem.parquet|' || i), 1, 8) < '0ccccccd'",
    "pca_variance": pca_curve_sql(4, f"SELECT i, j, r FROM ({PCA_MATRIX})"),
    "pca_variance_embeddings": pca_curve_sql(EMBEDDING_SIZE,
        "SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS r FROM x a JOIN x b USING (vec_id) GROUP BY a.i, b.i",
        "x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),"),
    "name_recommendations_factored": factored_sql(),
    "session_files": "SELECT file, file LIKE '%list.csv' AS found FROM (VALUES "
                     + ", ".join(f"({_q(f)})" for f in SESSION_FILES.values()) + ") x(file)",
    "session_columns": session_catalogue_sql(),
    "session_homogenize": SESSION_HOMOGENIZE_SQL,
    "session_homogenize_row_id": "SELECT 'customer list.csv' AS source_file, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, "
        "c_name AS name FROM customer UNION ALL SELECT 'supplier_combined.csv', row_number() OVER (ORDER BY s_suppkey) - 1, s_name "
        "FROM supplier UNION ALL SELECT 'part.csv', row_number() OVER (ORDER BY p_partkey) - 1, p_brand || ' ' || p_name FROM part",
    "session_recommend_names": name_recommendations_sql(70, session_catalogue_sql()),
    "session_recommend_values": tfidf_sql(_BY_FILE, False, 0.3, SESSION_FILES),
    "session_report_nulls": null_profile_sql(HOMOGENIZE_SQL, COMBINED),
    "session_report_histogram": histogram_sql(COMBINED_BALANCE, ""),
    "session_preview_records": "SELECT to_json({'s_suppkey': s_suppkey::VARCHAR, 's_name': s_name, "
                               "'s_nationkey': s_nationkey::VARCHAR, 's_acctbal': s_acctbal::VARCHAR})::VARCHAR AS record FROM supplier",
    "align_union_case": 'SELECT c_custkey AS "KEY", c_name AS "Name", NULL::DOUBLE AS bal FROM customer '
                        "UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "histogram_infinity": histogram_sql(WITH_INFINITY, ""),
    "non_finite_counts": f"SELECT 'value' AS \"column\", count(*) FILTER (isnan(v)) AS n_nan, "
                         f"count(*) FILTER (isinf(v)) AS n_infinite FROM ({WITH_INFINITY})",
    "pattern_conformance_newline": "WITH v AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN p_brand || chr(10) ELSE p_brand END AS b FROM part), "
        f"s AS (SELECT {_shape('b')} AS shape, count(*) AS n FROM v GROUP BY 1) "
        "SELECT 'brand' AS \"column\", shape, (SELECT count(*) FROM v) AS n_values, n AS n_match FROM s ORDER BY n DESC, shape LIMIT 1",
    "column_tfidf_wide": tfidf_sql(WIDE_COLUMNS, False, 0.5, doubles=WIDE_DOUBLES),
    "align_union": ALIGN_SQL,
    "homogenize": HOMOGENIZE_SQL,
    "homogenize_with_source": HOMOGENIZE_SQL.replace(
        "AS category FROM customer", "AS category, 'customer' AS source_file FROM customer").replace(
        "'' FROM supplier", "'', 'supplier' FROM supplier").replace(
        "coalesce(p_type, '') FROM part", "coalesce(p_type, ''), 'part' FROM part"),
    "header_catalogue": catalogue_sql(),
    "null_profile": null_profile_sql(ALIGN_SQL, TYPES["customer"] + TYPES["supplier"]),
    "null_profile_combined": null_profile_sql(HOMOGENIZE_SQL, COMBINED),
    "numeric_columns": castable_sql("orders", "SELECT * FROM orders", TYPES["orders"]) + " UNION ALL " +
                       castable_sql("combined", HOMOGENIZE_SQL, COMBINED),
    "categorical_columns": "SELECT p_name, p_brand, p_type FROM part",
    "iqr_fences": fences_sql(),
    "final_report_outliers": FINAL_REPORT_OUTLIERS_SQL,
    "iqr_outliers": outliers_rows_sql(),
    "outlier_report": outlier_report_sql(),
    "histogram": histogram_sql(_cells(HISTOGRAM_TARGETS)),
    "column_tfidf": tfidf_sql(TEXT_COLUMNS, False),
    "column_tfidf_normalized": tfidf_sql(NORMALIZED_TEXT_COLUMNS, True),
    "name_pairs": name_pairs_sql(),
    "name_recommendations": name_recommendations_sql(),
    "similar_name_groups": groups_sql(80),
    "normalize_text": f"SELECT doc_id, {NORMALIZE_KEEP_NULL.format(x='text')} AS text_norm FROM documents",
    "normalize_pages": f"SELECT page_id, {NORMALIZE_KEEP_NULL.format(x='html')} AS html_norm FROM pages",
    "value_shapes": shapes_sql(),
    "pattern_conformance": conformance_sql(),
    "sample_hash": ("SELECT * FROM lineitem WHERE substr(md5(concat_ws('|', '274', CAST(l_orderkey AS VARCHAR), "
                    "CAST(l_linenumber AS VARCHAR))), 1, 8) < '0ccccccd'"),
    "csv_round_trip": ("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) "
                       "AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"),
    "csv_quote_all": ("SELECT '\"' || CAST(c_custkey AS VARCHAR) || '\",\"' || c_name || '\",\"' || "
                      "CAST(c_nationkey AS VARCHAR) || '\",\"' || CAST(c_acctbal AS VARCHAR) || '\",\"' || "
                      "c_mktsegment || '\"' AS line FROM customer"),
    "preview": "SELECT * FROM customer ORDER BY c_custkey LIMIT 10",
    "pca_correlation": correlation_sql("lineitem", PCA_LINEITEM),
    "distinct_headers": f"SELECT DISTINCT column_name FROM ({catalogue_sql()})",
    "csv_multiline_documents": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents",
    "csv_single_line": ("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) "
                        "AS s_nationkey, CAST(s_acctbal AS VARCHAR) AS s_acctbal FROM supplier"),
}
