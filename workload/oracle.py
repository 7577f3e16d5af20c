"""The same results in SQL, written for DuckDB over the given tables and independent of the library."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

COLUMNS = ("order_id", "customer_id", "status", "amount", "order_date", "priority", "note")

NULLS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', "
    "'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)

DIRTY = """
dirty AS (
  SELECT o_orderkey AS _row_idx,
    CAST(o_orderkey AS VARCHAR) AS order_id,
    CASE WHEN o_orderkey % 17 = 3 THEN 'NA' ELSE 'C' || o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 19 = 5 THEN '' WHEN o_orderkey % 23 = 7 THEN ' ' || o_orderstatus || ' '
         ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 29 = 1 THEN 'n/a' WHEN o_orderkey % 31 = 2 THEN '1,234.50'
         WHEN o_orderkey % 37 = 4 THEN '1d' WHEN o_orderkey % 41 = 6 THEN 'not a number'
         ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
    CASE WHEN o_orderkey % 43 = 8 THEN 'not a date' WHEN o_orderkey % 47 = 9 THEN 'null'
         ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS order_date,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
    'order ' || o_orderkey || ' by customer ' || o_custkey AS note
  FROM orders
)"""

CLEAN = DIRTY + ",\nclean AS (SELECT _row_idx, " + ", ".join(
    f"CASE WHEN {c} IN {NULLS} THEN NULL ELSE {c} END AS {c}" for c in COLUMNS
) + " FROM dirty)"

CELLS = CLEAN + ",\ncells AS (\n" + "\nUNION ALL ".join(
    f"SELECT _row_idx, _row_idx // 1000 AS chunk_id, '{c}' AS col, {c} AS v FROM clean" for c in COLUMNS
) + ")"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def number(x: str) -> str:
    """Number of a text, or null; the texts here hold no digit separators."""
    return f"TRY_CAST(replace({x}, ',', '') AS DOUBLE)"


def is_date(x: str) -> str:
    """The date shapes that occur in the rendered inputs."""
    return (
        f"(CASE WHEN regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}( [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})?$') "
        f"THEN TRY_CAST({x} AS TIMESTAMP) IS NOT NULL "
        f"WHEN regexp_matches({x}, '^[0-9]{{8}}$') THEN TRY_CAST(substr({x},1,4) || '-' || substr({x},5,2) || '-' || substr({x},7,2) AS DATE) IS NOT NULL "
        f"ELSE regexp_matches({x}, '^(1[7-9][0-9]{{2}}|2[01][0-9]{{2}}|22[0-5][0-9])$') END)"
    )


JUDGED = CELLS + f""",
judged AS (
  SELECT *, {trimmed('v')} AS t, {number('v')} AS x, ({number('v')} IS NOT NULL) AS num,
    {is_date(trimmed('v'))} AS dt FROM cells
)"""


def facts(scope: str = "") -> str:
    """Aggregates of every column, straight from the cells."""
    by = f"{scope}col"
    return JUDGED + f""",
facts AS (
  SELECT {by}, count(*) AS n_rows, count(v) AS n, count(DISTINCT v) AS d,
    avg(length(v)) AS mean_length,
    avg(CASE WHEN regexp_matches(v, '^[0-9]+$') THEN 1.0 ELSE 0.0 END) FILTER (v IS NOT NULL) AS digits,
    avg(CASE WHEN regexp_matches(v, '^[\\p{{L}}\\p{{N}}]+$') THEN 1.0 ELSE 0.0 END) FILTER (v IS NOT NULL) AS alnum,
    count(x) AS castable,
    count(*) FILTER (v IS NOT NULL AND dt) AS dates,
    count(*) FILTER (t <> '') AS f, count(DISTINCT t) FILTER (t <> '') AS fd,
    avg(length(t)) FILTER (t <> '') AS f_length,
    count(*) FILTER (t <> '' AND num) AS f_num, count(*) FILTER (t <> '' AND NOT num AND dt) AS f_dt
  FROM judged GROUP BY {by}
),
hist AS (SELECT {by}, v, count(*) AS c, min(_row_idx) AS first_idx FROM cells WHERE v IS NOT NULL GROUP BY {by}, v),
ent AS (
  SELECT {by}, -sum((c / total) * ln(c / total)) AS entropy
  FROM (SELECT *, CAST(sum(c) OVER (PARTITION BY {by}) AS DOUBLE) AS total FROM hist) GROUP BY {by}
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY c DESC, first_idx) AS rank FROM hist
),
shares AS (
  SELECT *, f_num / f AS a, f_dt / f AS b, CASE WHEN fd / f < 0.2 AND f_length < 30 THEN 1.0 ELSE 0.0 END AS k FROM facts
),
scores AS (SELECT *, 1 - greatest(a, b, k) AS z, a + b + k + 1 - greatest(a, b, k) AS total FROM shares)"""


SCORES4 = 'round(a / total, 6) AS "numeric", round(b / total, 6) AS datetime, round(k / total, 6) AS categorical, round(z / total, 6) AS text'
ID_LIKE = "(d / n > 0.9 AND mean_length <= 32 AND (digits > 0.5 OR alnum > 0.7))"
TYPE = "CASE WHEN n = 0 THEN 'empty' WHEN castable > 0 THEN 'numeric' WHEN dates / n > 0.9 THEN 'datetime' WHEN d / n < 0.2 THEN 'categorical' ELSE 'text' END"


def define(name: str, ctes: str, body: str) -> None:
    ORACLE[name] = (f"WITH {ctes}\n" if ctes else "") + body


F = facts()
define("A5_null_tokens", CLEAN, "SELECT * FROM clean")
define("D1_is_numeric", JUDGED, 'SELECT DISTINCT col AS "column", v AS value, num AS is_numeric FROM judged WHERE v IS NOT NULL')
define(
    "C1_token_score",
    JUDGED,
    r"""SELECT DISTINCT col AS "column", v AS value,
  CASE WHEN t = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0,
    CASE WHEN num THEN 0 ELSE 0.3 END + CASE WHEN dt THEN 0 ELSE 0.2 END
    + 0.25 * length(regexp_replace(t, '[^\p{L}]', '', 'g')) / length(t)
    + CASE WHEN regexp_matches(replace(replace(t, '_', ''), '-', ''), '^[\p{L}\p{N}]+$') AND NOT regexp_matches(t, '^[0-9]') THEN 0.15 ELSE 0 END
    + CASE WHEN length(t) BETWEEN 2 AND 30 THEN 0.1 WHEN length(t) > 50 THEN -0.2 ELSE 0 END)) + 1e-9, 6) END AS likeness
FROM judged WHERE v IS NOT NULL""",
)
define("E1_null_rate", F, 'SELECT col AS "column", round(1 - n / n_rows, 6) AS null_rate FROM facts')
define("E2_distinct", F, 'SELECT col AS "column", d AS unique_count, round(d / n, 6) AS unique_ratio FROM facts')
define("D5_type_scores", F, f'SELECT col AS "column", {SCORES4} FROM scores')
define("E4_entropy", F, 'SELECT col AS "column", round(entropy, 6) AS entropy FROM ent')
define("E5_top_values", F, 'SELECT col AS "column", rank, v AS value, c AS cnt FROM ranked WHERE rank <= 10')
define("E6_id_like", F, f'SELECT col AS "column", {ID_LIKE} AS is_id_like FROM facts')
define("E7_avg_length", F, 'SELECT col AS "column", round(mean_length, 3) AS avg_length FROM facts')
define("E9_column_types", F, f'SELECT col AS "column", {TYPE} AS column_type FROM facts')
define(
    "E8_column_profile",
    facts("chunk_id, "),
    f"""SELECT s.chunk_id, s.col AS "column", round(1 - n / n_rows, 6) AS null_rate, d AS unique_count,
  round(d / n, 6) AS unique_ratio, {SCORES4}, round(e.entropy, 6) AS entropy,
  (SELECT string_agg(v, '~' ORDER BY rank) FROM ranked r WHERE r.chunk_id = s.chunk_id AND r.col = s.col AND rank <= 10) AS top_samples,
  {ID_LIKE} AS is_id_like, round(mean_length, 3) AS avg_length, {TYPE} AS column_type
FROM scores s JOIN ent e ON e.chunk_id = s.chunk_id AND e.col = s.col""",
)

define(
    "E8_merged_profile",
    F + ", per AS (SELECT col, max(k) <= 100 AS few FROM (SELECT col, chunk_id, count(DISTINCT v) AS k FROM cells GROUP BY ALL) GROUP BY col),"
    " state AS (SELECT *, few AND d <= 100 AS exact FROM scores JOIN per USING (col))",
    f"""SELECT s.col AS "column", n_rows AS rows, round(1 - n / n_rows, 6) AS null_rate, round(mean_length, 3) AS avg_length, {TYPE} AS column_type,
  round(a / total, 6) AS "numeric", round(b / total, 6) AS datetime, exact, CASE WHEN exact THEN d END AS unique_count,
  CASE WHEN exact THEN round(e.entropy, 6) END AS entropy,
  CASE WHEN exact THEN (SELECT string_agg(v, '~' ORDER BY rank) FROM ranked r WHERE r.col = s.col AND rank <= 10) END AS top_samples
FROM state s JOIN ent e ON e.col = s.col""",
)

WIDE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def wide_text(c: str) -> str:
    if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"
    return f"strftime({c}, '%Y-%m-%d')" if c == "l_shipdate" else f"CAST({c} AS VARCHAR)"


define(
    "E8_wide_profile",
    "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {wide_text(c)} AS v FROM lineitem" for c in WIDE) + f"""),
hist AS (SELECT col, v, count(*) AS c FROM cells GROUP BY col, v),
facts AS (SELECT col, sum(c) AS n, count(*) AS d, sum(c * length(v)) / sum(c) AS mean_length,
  sum(CASE WHEN regexp_matches(v, '^[0-9]+$') THEN c ELSE 0 END) / sum(c) AS digits,
  sum(CASE WHEN regexp_matches(v, '^[a-zA-Z0-9]+$') THEN c ELSE 0 END) / sum(c) AS alnum,
  count(TRY_CAST(v AS DOUBLE)) AS castable, sum(CASE WHEN {is_date('v')} THEN c ELSE 0 END) AS dates,
  ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM hist GROUP BY col)""",
    f'SELECT col AS "column", d AS unique_count, round(entropy, 6) AS entropy, round(mean_length, 3) AS avg_length, {ID_LIKE} AS is_id_like, {TYPE} AS column_type FROM facts',
)

define(
    "E8_text_profile",
    "cells AS (" + " UNION ALL ".join(f"SELECT doc_id AS _row_idx, '{c}' AS col, {c} AS v FROM documents" for c in ("text", "lang", "source"))
    + ")" + F[F.index(",\njudged AS"):],
    f"""SELECT s.col AS "column", d AS unique_count, round(e.entropy, 6) AS entropy,
  md5((SELECT string_agg(v, '~' ORDER BY rank) FROM ranked r WHERE r.col = s.col AND rank <= 10)) AS top_samples,
  round(mean_length, 3) AS avg_length, {ID_LIKE} AS is_id_like, {TYPE} AS column_type, {SCORES4}
FROM scores s JOIN ent e ON e.col = s.col""",
)

# ---- row anomalies ----

NUMBERS = CLEAN + f""",
num AS (SELECT *, _row_idx // 1000 AS chunk_id, {number('order_id')} AS x1, {number('amount')} AS x2,
  (CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END + CASE WHEN status IS NULL THEN 1 ELSE 0 END
   + CASE WHEN order_date IS NULL THEN 1 ELSE 0 END + CASE WHEN priority IS NULL THEN 1 ELSE 0 END
   + CASE WHEN note IS NULL THEN 1 ELSE 0 END + CASE WHEN {number('order_id')} IS NULL THEN 1 ELSE 0 END
   + CASE WHEN {number('amount')} IS NULL THEN 1 ELSE 0 END) / 7 AS missing FROM clean)"""


def anomalies(scope: str) -> str:
    over = f"OVER (PARTITION BY {scope})" if scope else "OVER ()"
    z = "coalesce(abs({x} - avg({x}) {over}) / nullif(stddev_pop({x}) {over}, 0), 0)"
    return NUMBERS + f""",
zs AS (SELECT *, {z.format(x='x1', over=over)} AS z1, {z.format(x='x2', over=over)} AS z2 FROM num),
mz AS (SELECT *, (z1 + z2) / 2 AS mean_z FROM zs),
marked AS (SELECT *, 0.7 * (mean_z - min(mean_z) {over}) / (max(mean_z) {over} - min(mean_z) {over} + 1e-9) + 0.3 * missing AS score FROM mz)"""


G = anomalies("")
define("F1_missing_ratio", CLEAN, "SELECT _row_idx, round((" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in COLUMNS) + ") / 7, 6) AS missing_ratio FROM clean")
define("F2_abs_zscore", G, "SELECT _row_idx, round(z1, 6) AS z_order_id, round(z2, 6) AS z_amount FROM marked")
define("F3_mean_z", anomalies("chunk_id"), "SELECT _row_idx, round(mean_z, 6) AS mean_z, round(missing, 6) AS missing_ratio FROM marked")
define("F6_anomaly_ensemble", G, "SELECT _row_idx, round(score, 6) AS score FROM marked")
define("H10_anomaly_share", G, "SELECT round(avg(CASE WHEN score > 0.4 THEN 1.0 ELSE 0.0 END), 6) AS anomaly_presence FROM marked")
define("B1_chunk_sink", anomalies("chunk_id"), "SELECT chunk_id, CAST(CAST(order_id AS BIGINT) AS VARCHAR) AS order_id, round(score, 6) AS score FROM marked")
define(
    "F4_length_z",
    CLEAN + """,
l AS (SELECT _row_idx, CAST(coalesce(length(customer_id), 3) + coalesce(length(status), 3) + coalesce(length(order_date), 3)
    + coalesce(length(priority), 3) + coalesce(length(note), 3) AS DOUBLE) AS size,
  (CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END + CASE WHEN status IS NULL THEN 1 ELSE 0 END
   + CASE WHEN order_date IS NULL THEN 1 ELSE 0 END + CASE WHEN priority IS NULL THEN 1 ELSE 0 END
   + CASE WHEN note IS NULL THEN 1 ELSE 0 END) / 5 AS missing FROM clean),
z AS (SELECT *, abs(size - avg(size) OVER ()) / stddev_pop(size) OVER () AS z FROM l)""",
    "SELECT _row_idx, round(z, 6) AS length_z, round(0.6 * (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER () + 1e-9) + 0.4 * missing, 6) AS score FROM z",
)
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
define(
    "F7_mark_anomalies",
    "s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_NUMBERS) + " FROM lineitem),\n"
    "z AS (SELECT l_returnflag, l_linestatus, (" + " + ".join(f"abs({c} - m_{c}) / s_{c}" for c in LINE_NUMBERS) + ") / 8 AS z FROM lineitem, s),\n"
    "r AS (SELECT min(z) AS lo, max(z) AS hi FROM z),\n"
    "a AS (SELECT l_returnflag, l_linestatus, 0.7 * (z - lo) / (hi - lo + 1e-9) AS score FROM z, r)",
    "SELECT l_returnflag, l_linestatus, count(*) AS marked_rows, round(avg(score), 5) AS mean_score, round(max(score), 5) AS max_score FROM a GROUP BY 1, 2",
)
define("D4_coerce_numeric", NUMBERS, "SELECT _row_idx, round(x1, 6) AS order_id, round(x2, 6) AS amount, customer_id, status FROM num")
define(
    "H2_sparsity",
    NUMBERS,
    "SELECT 'orders' AS \"table\", round(sum(missing * 7) / (7 * count(*)), 6) AS sparsity FROM num",
)
define(
    "A9_typed_scan",
    CLEAN,
    "SELECT CAST(_row_idx AS DOUBLE) AS k, CAST(order_id AS DOUBLE) AS order_id, customer_id, status, amount, order_date, priority, note FROM clean",
)
BY_CHUNK = anomalies("chunk_id")
define(
    "B2_chunk_metadata",
    BY_CHUNK + (""",
h AS (SELECT chunk_id, amount AS v, count(*) AS c FROM clean_chunk WHERE amount IS NOT NULL GROUP BY 1, 2),
e AS (SELECT chunk_id, count(*) AS u, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM h GROUP BY 1),
numbers AS (SELECT chunk_id, """ + number("amount") + """ AS x FROM clean_chunk),
amount_z AS (SELECT chunk_id, sum(abs(x - mean) / std) AS z FROM (SELECT *, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS std FROM numbers WINDOW w AS (PARTITION BY chunk_id)) GROUP BY 1)""").replace(
        "clean_chunk", "(SELECT _row_idx // 1000 AS chunk_id, amount FROM clean)"
    ),
    """SELECT m.chunk_id, 'orders' AS source_file, min(_row_idx) AS row_offset, count(*) AS chunk_rows, CAST(8 AS BIGINT) AS n_columns,
  'numeric' AS amount_type, round(1 - count(amount) / count(*), 6) AS amount_null_rate, any_value(u) AS amount_unique,
  round(any_value(entropy), 6) AS amount_entropy, round(sum(score), 4) AS score_sum, round(any_value(z), 4) AS amount_z_sum
FROM marked m JOIN e ON e.chunk_id = m.chunk_id JOIN amount_z ON amount_z.chunk_id = m.chunk_id GROUP BY m.chunk_id""",
)

# ---- rendered files ----

SEP = "(CASE o_custkey % 4 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN '|' ELSE ';' END)"
LINES = f'''
lines AS (
  SELECT 'file_' || o_custkey AS file_id, o_orderkey + 10 AS line_no,
    concat_ws({SEP}, CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'),
      CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), o_orderstatus,
      CASE WHEN o_custkey % 7 = 0 THEN '"' || o_orderpriority || {SEP} || ' ""x"""' ELSE o_orderpriority END) AS line
  FROM orders
  UNION ALL
  SELECT 'file_' || o_custkey, 0, '# exported for customer ' || o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 5 = 0
  UNION ALL
  SELECT 'file_' || o_custkey, 1, '   ' FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 3 = 0
  UNION ALL
  SELECT 'file_' || o_custkey, 2, CASE WHEN o_custkey % 11 = 0 THEN concat_ws({SEP}, '1995', '1996', '1997', '1998', '1999')
      ELSE concat_ws({SEP}, 'order_id', 'order_date', 'amount', 'status', 'priority') END
  FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 13 <> 0
),
head AS (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS row FROM lines WHERE trim(line) <> ''
  QUALIFY row < 200
)'''

SEPARATORS = {"','": ",", "chr(9)": "\\t", "'|'": "\\|", "';'": ";"}


def pieces(line: str, sep: str, pattern: str) -> str:
    bare = pattern.replace("\\|", "|")
    return f"""regexp_extract_all({sep} || {line}, '{pattern}("(?:[^"]|"")*"|[^{bare}]*)', 1)"""


COMMENT = r"regexp_matches(ltrim(line), '^(#|//|--|/\*|<!--|;|%)')"


def detection(mode: str) -> str:
    """All steps from lines to scored candidates."""
    counts = ", ".join(f"len({pieces('line', s, p)}) AS c{i}" for i, (s, p) in enumerate(SEPARATORS.items()))
    used = f"WHERE NOT {COMMENT}" if mode == "robust" else ""
    eligible = "CASE WHEN m > 1 THEN 1 ELSE 0 END" if mode == "robust" else "1"
    fields = "CASE " + " ".join(f"WHEN delimiter = {s} THEN {pieces('line', s, p)}" for s, p in SEPARATORS.items()) + " END"
    plain = "string_split(line, delimiter)"
    unquote = """CASE WHEN length({f}) >= 2 AND {f}[1] = '"' AND {f}[-1] = '"' THEN replace({f}[2:-2], '""', '"') ELSE {f} END"""
    split = f"""list_transform({fields}, lambda f: {unquote.format(f='f')})"""
    tokens = "fields" if mode == "robust" else plain
    candidate = f"AND NOT {COMMENT}" if mode == "robust" else ""
    token = trimmed("token")
    return LINES + f""",
counts AS (SELECT file_id, {counts} FROM head {used}),
stats AS (
  {" UNION ALL ".join(f"SELECT file_id, {i} AS pref, {s} AS delimiter, avg(c{i}) AS m, stddev_pop(c{i}) AS s FROM counts GROUP BY file_id" for i, s in enumerate(SEPARATORS))}
),
sniffed AS (
  SELECT file_id, delimiter FROM stats
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY {eligible} DESC, (m + 1e-9) / (s + 1e-9) DESC, pref) = 1
),
split_lines AS (
  SELECT file_id, row, line_no, line, delimiter, {split} AS fields FROM head JOIN sniffed USING (file_id) WHERE row <= 28
),
parts AS (SELECT file_id, row, unnest(fields) AS field, unnest(range(len(fields))) AS j FROM split_lines),
part_facts AS (
  SELECT file_id, row, j, t, num, (NOT num AND dt) AS dt, length(t) AS size, x FROM (
    SELECT file_id, row, j, {trimmed('field')} AS t, {number('field')} AS x, ({number('field')} IS NOT NULL) AS num, {is_date(trimmed('field'))} AS dt
    FROM parts WHERE field NOT IN {NULLS})
),
candidates AS (
  SELECT c.*, len(c.fields) AS width,
    greatest(coalesce((SELECT len(n.fields) FROM split_lines n WHERE n.file_id = c.file_id AND n.row = c.row + 1), 0) - len(c.fields), 0) AS shift
  FROM split_lines c WHERE row <= 8 {candidate}
),
blocked AS (
  SELECT c.*, NOT EXISTS (SELECT 1 FROM split_lines b WHERE b.file_id = c.file_id AND b.row BETWEEN c.row + 1 AND c.row + 20
    AND len(b.fields) > c.width + c.shift) AS parsed FROM candidates c
),
token_facts AS (
  SELECT file_id, row, t, num, (t = '' OR dt) AS dt,
    CASE WHEN t = '' THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN num THEN 0 ELSE 0.3 END + CASE WHEN dt THEN 0 ELSE 0.2 END
      + 0.25 * length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / length(t)
      + CASE WHEN regexp_matches(replace(replace(t, '_', ''), '-', ''), '^[\\p{{L}}\\p{{N}}]+$') AND NOT regexp_matches(t, '^[0-9]') THEN 0.15 ELSE 0 END
      + CASE WHEN length(t) BETWEEN 2 AND 30 THEN 0.1 WHEN length(t) > 50 THEN -0.2 ELSE 0 END)) END AS likeness
  FROM (SELECT file_id, row, {token} AS t, ({number(token)} IS NOT NULL) AS num, {is_date(token)} AS dt
    FROM (SELECT file_id, row, unnest({tokens}) AS token FROM candidates))
),
token_scores AS (
  SELECT file_id, row, count(*) AS token_count, avg(likeness) AS token_score,
    0.4 * (avg(CASE WHEN num THEN 1.0 ELSE 0.0 END) + 0.8 * avg(CASE WHEN dt THEN 1.0 ELSE 0.0 END)) AS data_row_penalty,
    count(DISTINCT t) / (count(*) + 1e-9) AS uniqueness_score
  FROM token_facts GROUP BY 1, 2
),
ordinals AS (SELECT file_id, row, shift, unnest(range(width)) AS ordinal FROM blocked WHERE parsed),
column_facts AS (
  SELECT o.file_id, o.row, o.ordinal, count(p.t) AS present, count(*) FILTER (p.t <> '') AS n,
    count(*) FILTER (p.t <> '' AND p.num) AS n_num, count(*) FILTER (p.t <> '' AND p.dt) AS n_dt,
    count(DISTINCT p.t) FILTER (p.t <> '') AS d, avg(p.size) FILTER (p.t <> '') AS mean_length,
    coalesce(stddev_pop(p.x), 0) AS spread,
    coalesce(bool_or(p.num) FILTER (p.row = o.row + 1), true) AS first_numeric
  FROM ordinals o LEFT JOIN part_facts p ON p.file_id = o.file_id AND p.row BETWEEN o.row + 1 AND o.row + 20 AND p.j = o.shift + o.ordinal
  GROUP BY 1, 2, 3
),
column_shares AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE n_num / n END AS a, CASE WHEN n = 0 THEN 0 ELSE n_dt / n END AS b,
    CASE WHEN n > 0 AND d / n < 0.2 AND mean_length < 30 THEN 1.0 ELSE 0.0 END AS k FROM column_facts
),
column_scores AS (
  SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(a, b, k, 1 - greatest(a, b, k)) / (a + b + k + 1 - greatest(a, b, k)) END AS dominant FROM column_shares
),
block_scores AS (
  SELECT file_id, row, avg(dominant) AS consistency_score, greatest(0.0, least(1.0, 1 - avg(spread))) AS stability
  FROM column_scores GROUP BY 1, 2
),
candidate_scores AS (
  SELECT c.file_id, c.row, c.line_no, c.line, c.parsed, token_count, consistency_score, token_score, uniqueness_score, stability, data_row_penalty,
    CASE WHEN c.parsed THEN greatest(0.0, 0.30 * consistency_score + 0.40 * token_score + 0.15 * uniqueness_score + 0.15 * stability - data_row_penalty) ELSE 0.0 END AS score
  FROM blocked c JOIN token_scores t USING (file_id, row) LEFT JOIN block_scores b USING (file_id, row)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY round(score, 12) DESC, row) AS rank FROM candidate_scores),
picked AS (
  SELECT file_id, max(row) FILTER (rank = 1) AS best_row, max(line_no) FILTER (rank = 1) AS best_line_no, max(score) FILTER (rank = 1) AS best_score,
    max(line_no) FILTER (row = 0) AS first_line_no, max(score) FILTER (row = 0) AS first_score
  FROM ranked GROUP BY file_id
),
reasons AS (
  SELECT p.*, CASE WHEN f.comment THEN 'first_row_is_comment' WHEN best_row = 0 THEN 'first_row_is_best'
      WHEN best_score - first_score < 0.40 THEN 'small_gap_' || printf('%.3f', best_score - first_score + 1e-9)
      ELSE 'first_row_rejected_gap_' || printf('%.3f', best_score - first_score + 1e-9) END AS selection_reason
  FROM picked p JOIN (SELECT file_id, {COMMENT} AS comment FROM head WHERE row = 0) f USING (file_id)
),
selected AS (
  SELECT file_id, selection_reason, coalesce(first_score, 0) AS first_row_score,
    CASE WHEN selection_reason = 'first_row_is_best' OR selection_reason LIKE 'small_gap%' THEN 0 ELSE best_row END AS header_row,
    CASE WHEN selection_reason = 'first_row_is_best' OR selection_reason LIKE 'small_gap%' THEN first_line_no ELSE best_line_no END AS header_line_no,
    CASE WHEN selection_reason = 'first_row_is_best' OR selection_reason LIKE 'small_gap%' THEN first_score ELSE best_score END AS score
  FROM reasons
),
levels AS (
  SELECT *, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' WHEN score >= 0.3 THEN 'LOW' ELSE 'UNCERTAIN' END AS confidence FROM selected
),
detected AS (
  SELECT *, confidence IN ('UNCERTAIN', 'LOW') AS needs_review,
    CASE confidence WHEN 'UNCERTAIN' THEN 'confidence_too_low' WHEN 'LOW' THEN 'low_confidence_suggest_review'
      ELSE CASE WHEN selection_reason LIKE '%rejected%' THEN 'first_row_rejected_but_confident' ELSE 'confident' END END AS review_reason
  FROM levels
),
top3 AS (
  SELECT file_id, string_agg(CAST(row AS VARCHAR), ',' ORDER BY rank) AS top_rows, string_agg(substr(line, 1, 80), '~' ORDER BY rank) AS previews,
    string_agg('  Row ' || row || ': score=' || printf('%.3f', round(score, 4) + 1e-9), chr(10) ORDER BY rank) AS candidate_text
  FROM ranked WHERE rank <= 3 GROUP BY file_id
)"""


H = detection("robust")
PARTS = ("consistency_score", "token_score", "uniqueness_score", "stability", "data_row_penalty", "score")
define("A3_sniff_delimiter", H, "SELECT file_id, delimiter FROM sniffed")
define("A8_raw_preview", LINES, "SELECT file_id, row, line FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS row FROM lines) WHERE row < 20")
define("C2_header_candidates", H, "SELECT file_id, row, token_count, " + ", ".join(f"round({p}, 6) AS {p}" for p in PARTS) + ", 'scored' AS reason FROM ranked WHERE parsed")
define("C3_rank_candidates", H, "SELECT file_id, row, rank, round(score, 6) AS score FROM ranked")
define("C4_comment_lines", LINES, f"SELECT file_id, line_no, {COMMENT} AS is_comment FROM lines")
define("C5_select_header", H, "SELECT file_id, header_row, header_line_no, round(score, 6) AS score, round(first_row_score, 6) AS first_row_score, selection_reason FROM selected")
define("C6_confidence", H, "SELECT confidence, count(*) AS files FROM detected GROUP BY 1")
define("C7_review_flag", H, "SELECT file_id, confidence, needs_review, review_reason FROM detected")
define(
    "C8_detection_result", H,
    "SELECT file_id, header_row, confidence, round(score, 4) AS confidence_score, needs_review, selection_reason, top_rows, previews FROM detected JOIN top3 USING (file_id)",
)
define(
    "C9_header_by_consistency",
    detection("compat"),
    """SELECT f.file_id, coalesce(b.row, 0) AS header_row, round(coalesce(b.score, -1), 6) AS score
FROM (SELECT DISTINCT file_id FROM head) f LEFT JOIN (
  SELECT file_id, row, avg(dominant) FILTER (present > 0) - 0.3 * avg(CASE WHEN first_numeric THEN 1.0 ELSE 0.0 END) AS score
  FROM column_scores GROUP BY 1, 2 HAVING count(*) > 1 AND max(present) > 0
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY round(score, 12) DESC, row) = 1) b USING (file_id)""",
)
define(
    "C10_review_gate", H,
    "SELECT file_id, header_row AS original_header_row, header_row AS reviewed_header_row, false AS changed, CASE WHEN needs_review THEN 'llm' ELSE 'skipped' END AS review_source, '' AS reasoning FROM detected",
)
define(
    "C11_review_prompts", H,
    f"""SELECT d.file_id, 'Analyze this CSV:' || chr(10) || chr(10) || shown || chr(10) || chr(10) || 'L1 candidates:' || chr(10) || candidate_text AS prompt
FROM detected d JOIN top3 USING (file_id) JOIN (
  SELECT file_id, string_agg('Row ' || row || ': ' || {trimmed('line')}, chr(10) ORDER BY row) AS shown
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) - 1 AS row FROM lines) WHERE row < 10 GROUP BY file_id) s USING (file_id)
WHERE needs_review""",
)
define(
    "C12_apply_reviews", H + """,
replies AS (
  SELECT file_id, CAST(substr(file_id, 6) AS BIGINT) AS cust FROM detected
),
answers AS (
  SELECT d.*, CASE WHEN cust % 4 = 0 THEN cust % 3 WHEN cust % 4 = 1 THEN 1 END AS answered,
    CASE WHEN cust % 4 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS sure, CASE WHEN cust % 4 = 0 THEN 'labels' ELSE '' END AS why
  FROM detected d JOIN replies USING (file_id)
)""",
    """SELECT file_id, header_row AS original_header_row,
  CASE WHEN needs_review AND answered IS NOT NULL THEN answered ELSE header_row END AS reviewed_header_row,
  (needs_review AND answered IS NOT NULL AND answered <> header_row) AS changed,
  CASE WHEN needs_review AND answered IS NOT NULL THEN sure ELSE 'N/A' END AS review_confidence,
  CASE WHEN needs_review AND answered IS NOT NULL THEN why ELSE '' END AS reasoning,
  CASE WHEN NOT needs_review THEN 'skipped' WHEN answered IS NOT NULL THEN 'llm' ELSE 'fallback' END AS review_source
FROM answers""",
)
define(
    "A4_adaptive_scan", H,
    """SELECT 'file_' || o_custkey AS file_id, CAST(o_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, o_orderstatus AS status,
  CASE WHEN o_custkey % 7 = 0 THEN o_orderpriority || """ + SEP + """ || ' "x"' ELSE o_orderpriority END AS priority
FROM orders JOIN selected ON selected.file_id = 'file_' || o_custkey WHERE o_orderkey + 10 > header_line_no""",
)
define(
    "A4_line_count", H,
    """SELECT f.file_id, count(*) AS lines, CAST(1 AS BIGINT) AS headers, count(*) FILTER (f.line_no > s.header_line_no) AS rows,
  count(*) FILTER (f.line_no < s.header_line_no) AS skipped FROM lines f JOIN selected s USING (file_id) GROUP BY f.file_id""",
)
define(
    "A4_multiline", "",
    """SELECT o_custkey % 16 AS g, row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1 AS _row_idx, CAST(o_orderkey AS VARCHAR) AS order_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'order ' || o_orderkey || chr(10) || chr(10) || 'says "now", twice' || chr(10) WHEN 1 THEN 'by, ' || o_custkey ELSE 'plain' END AS note,
  o_orderstatus AS status, CAST(CASE o_orderkey % 3 WHEN 0 THEN 4 ELSE 1 END AS BIGINT) AS lines FROM orders""",
)
define("F5_planted_outliers", "", "SELECT c_custkey FROM customer WHERE c_custkey % 500 = 7")
define(
    "A4_scan_files", "",
    """SELECT o_custkey % 64 AS g, row_number() OVER (PARTITION BY o_custkey % 64 ORDER BY o_orderkey) - 1 AS _row_idx,
  CAST(o_orderkey AS VARCHAR) AS order_id, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount, o_orderstatus AS status, o_orderpriority AS priority FROM orders""",
)
define(
    "A1_head_lines",
    """l AS (
  SELECT o_custkey % 64 AS g, o_orderkey + 1 AS k, concat_ws(',', CAST(o_orderkey AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'),
    CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), o_orderstatus, o_orderpriority) AS line FROM orders
  UNION ALL SELECT DISTINCT o_custkey % 64, 0, 'order_id,order_date,amount,status,priority' FROM orders),
p AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY g ORDER BY k) - length(line) - 1 AS pos FROM l)""",
    "SELECT g, 'ascii' AS encoding, count(*) AS head_lines, CAST(sum(least(length(line), 65536 - pos)) AS BIGINT) AS head_chars FROM p WHERE pos < 65536 GROUP BY g",
)
define(
    "A2_encoding", "",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'latin1' WHEN doc_id % 4 = 2 THEN 'utf-8-sig'
  WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END AS encoding FROM documents""",
)
define(
    "A6_unique_names",
    """raw AS (SELECT o_custkey AS file_id, o_orderkey AS ordinal, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS raw_name FROM orders),
based AS (SELECT *, CASE WHEN raw_name = '' THEN 'Unnamed: ' || ordinal ELSE raw_name END AS base FROM raw),
seen AS (SELECT *, row_number() OVER (PARTITION BY file_id, base ORDER BY ordinal) - 1 AS seen FROM based)""",
    "SELECT file_id, ordinal, raw_name, CASE WHEN seen > 0 THEN base || '__dup' || seen ELSE base END AS name FROM seen",
)
define(
    "A7_chunks",
    "n AS (SELECT row_number() OVER (ORDER BY event_id * 3 + user_id % 3) - 1 AS i FROM events)",
    "SELECT i // 1000 AS chunk_id, min(i) AS row_offset, count(*) AS chunk_rows FROM n GROUP BY 1",
)
define(
    "D2_is_datetime", "",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 12 < 9 THEN true WHEN o_orderkey % 12 = 11 THEN o_orderkey BETWEEN 1700 AND 2259 ELSE false END AS is_datetime FROM orders",
)

# ---- semantic channel ----

SCHEMAS = {
    "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]),
    "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]),
    "events": ("event_id", ["event_id", "ts", "user_id", "event_type", "value", "props"]),
    "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]),
}
TEXTS = {
    "o_orderstatus", "o_orderpriority", "c_name", "c_mktsegment", "p_name", "p_brand", "p_type", "s_name", "event_type",
    "props", "text", "lang", "source", "url", "html",
}
TIMES = {"o_orderdate", "ts"}
WORDS = {
    "financial_indicators": "price amount balance transaction payment revenue profit cost fee tax currency rate interest 价格 金额 余额 交易 支付 收入 利润 费用".split(),
    "geographical_indicators": "city country state province address location latitude longitude zip postal region area 城市 国家 省份 地址 位置 区域".split(),
    "pii_indicators": "name email phone ssn passport id_card birth age gender address identity 姓名 邮箱 电话 身份证 护照 出生 年龄 性别".split(),
    "temporal_pattern": "date time timestamp datetime year month day hour minute created updated expired 日期 时间 年 月 日 时 分 秒".split(),
}
ALL = (
    "temporal_pattern", "numeric_density", "sparsity", "categorical_presence", "relational_structure", "text_richness",
    "high_cardinality", "distribution_skewed", "distribution_heavy_tail", "periodicity", "anomaly_presence",
    "financial_indicators", "geographical_indicators", "pii_indicators", "hierarchical_structure",
)


def first_texts(source: str, key: str, columns: list[str], n: int) -> str:
    """The first values of the text columns of a table."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, r, v FROM (SELECT CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY {key}) AS r FROM {source} WHERE {c} IS NOT NULL) WHERE r <= {n}"
        for c in columns
    )


def joined_text(name: str, source: str, key: str, columns: list[str], texts: list[str]) -> str:
    return (
        f"SELECT '{name}' AS tab, '{' '.join(columns)}' || ' ' || coalesce((SELECT string_agg(lower(v), ' ') FROM ({first_texts(source, key, texts, 20)})), '') AS body"
    )


def keyword_columns() -> str:
    return ", ".join(
        "least(1.0, (" + " + ".join(f"CAST(contains(body, '{w}') AS INT)" for w in words) + f") / ({len(words)} * 0.15)) AS {a}"
        for a, words in WORDS.items()
    )


def key_share(columns: list[str]) -> float:
    parts = ("_id", "id_", "_key", "key_", "_pk", "_fk")
    return sum(any(p in c.lower() for p in parts) for c in columns) / len(columns)


BODIES = "bodies AS (" + " UNION ALL ".join(
    joined_text(t, t, k, cols, [c for c in cols if c in TEXTS]) for t, (k, cols) in SCHEMAS.items()
) + "),\nwords AS (SELECT tab, " + keyword_columns() + " FROM bodies)"
define("G1_keyword_scores", BODIES, 'SELECT tab AS "table", ' + ", ".join(f"round({a}, 6) AS {a}" for a in WORDS) + " FROM words")
define(
    "G2_value_sample", CLEAN,
    "SELECT col AS \"column\", string_agg(lower(v), ' ' ORDER BY r) AS sample_text FROM (" + first_texts("clean", "_row_idx", list(COLUMNS), 20) + ") GROUP BY col",
)
COMMERCE_COLUMNS = ["order_id", "customer_id", "customer_name", "amount", "tax", "rebate", "quantity", "order_date", "shipped", "status", "priority", "region", "nation", "segment"]
CUSTOMER_COLUMNS = ["customer_id", "customer_name", "region", "nation", "segment", "balance"]
define(
    "G3_column_patterns", "",
    " UNION ALL ".join(
        [f"SELECT '{t}' AS \"table\", count(*) AS rows, round(CAST({key_share(c)} AS DOUBLE), 6) AS relational_structure FROM {t}" for t, (_, c) in SCHEMAS.items()]
        + [
            f"SELECT 'commerce', count(*), round(CAST({key_share(COMMERCE_COLUMNS)} AS DOUBLE), 6) FROM orders",
            f"SELECT 'customers', count(*), round(CAST({key_share(CUSTOMER_COLUMNS)} AS DOUBLE), 6) FROM customer",
        ]
    ),
)
define(
    "G4_embedding_consistency",
    """v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
n AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm FROM v),
s AS (SELECT label, i, sum(x / norm) AS s, count(*) AS n FROM n GROUP BY 1, 2)""",
    "SELECT CAST(label AS BIGINT) AS label, max(n) AS n, round((sum(s * s) - max(n)) / (CAST(max(n) AS DOUBLE) * (max(n) - 1)), 5) AS semantic_consistency FROM s GROUP BY label",
)


def attribute_table(columns: dict[str, str], name: str, source: str) -> str:
    return " UNION ALL ".join(f"SELECT {name} AS tab, '{a}' AS attribute, CAST({columns.get(a, '0')} AS DOUBLE) AS score FROM {source}" for a in ALL)


SHARES = "CASE tab " + " ".join(f"WHEN '{t}' THEN {key_share(c)}" for t, (_, c) in SCHEMAS.items()) + " END"
define(
    "G5_semantic_scores", BODIES,
    'SELECT tab AS "table", attribute, round(score, 6) AS score FROM ('
    + attribute_table({**{a: a for a in WORDS}, "relational_structure": SHARES}, "tab", "words") + ")",
)

# ---- statistical channel ----


def per_table(measure, note: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS \"table\", {measure(t, k, c)} FROM {t}" for t, (k, c) in SCHEMAS.items())


def numeric(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in TEXTS and c not in TIMES]


def mean_of(items: list[str], scale: float) -> str:
    return f"least(1.0, ({' + '.join(items)}) / {len(items)} / {scale})"


def pop_skew(c: str, source: str) -> str:
    return f"(SELECT abs(avg(power(({c}) - m, 3)) / power(any_value(s), 3)) FROM {source}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {source}))"


def pop_kurt(c: str, source: str) -> str:
    return f"(SELECT abs(avg(power(({c}) - m, 4)) / power(any_value(s), 4) - 3) FROM {source}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {source}))"


def outliers(c: str, source: str) -> str:
    return f"(SELECT avg(CASE WHEN abs({c} - m) / s > 3 THEN 1.0 ELSE 0.0 END) FROM {source}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {source}))"


define("H1_numeric_density", "", per_table(lambda t, k, c: f"count(*) AS rows, round(CAST({len(numeric(c))} AS DOUBLE) / {len(c)}, 6) AS numeric_density"))
define(
    "H4_categorical", "",
    per_table(lambda t, k, c: "round((" + " + ".join([f"CASE WHEN count(DISTINCT {x}) / count(*) < 0.3 THEN 1.0 ELSE 0.0 END" for x in c if x in TEXTS] or ["0"]) + f") / {len(c)}, 6) AS categorical_presence"),
)
define(
    "H6_high_cardinality", "",
    per_table(lambda t, k, c: "round((" + " + ".join(f"CASE WHEN count(DISTINCT {x}) / count(*) > 0.8 THEN 1.0 ELSE 0.0 END" for x in c) + f") / {len(c)}, 6) AS high_cardinality"),
)
define("H7_skew", "", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", round({mean_of([pop_skew(x, t) for x in numeric(c)], 2)}, 6) AS distribution_skewed" for t, (_, c) in SCHEMAS.items()))
define("H8_kurtosis", "", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", round({mean_of([pop_kurt(x, t) for x in numeric(c)], 5)}, 6) AS distribution_heavy_tail" for t, (_, c) in SCHEMAS.items()))
define(
    "H11_outlier_share", "",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", round(least(1.0, 10 * greatest({', '.join(outliers(x, t) for x in numeric(c))})), 6) AS anomaly_presence" for t, (_, c) in SCHEMAS.items()),
)

GEO = """geo AS (SELECT c_custkey AS _row_idx, c_custkey AS customer_id, c_name AS customer_name, r_name AS region, n_name AS nation,
  c_mktsegment AS segment, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
COMMERCE = GEO + """,
commerce AS (SELECT o_orderkey AS _row_idx, o_orderkey AS order_id, 'C' || o_custkey AS customer_id, customer_name, o_totalprice AS amount,
  o_totalprice * 0.1 + 5 AS tax, o_totalprice * -0.2 AS rebate, o_orderkey % 7 AS quantity, o_orderdate AS order_date,
  strftime(o_orderdate, '%Y-%m-%d') AS shipped, o_orderstatus AS status, o_orderpriority AS priority, region, nation,
  CASE WHEN o_orderkey % 10 <> 0 THEN segment END AS segment FROM orders JOIN geo ON o_custkey = customer_id)"""


def temporal(name: str, source: str, key: str, texts: list[str], times: int, width: int) -> str:
    return (
        f"SELECT '{name}' AS \"table\", round(({times} + (SELECT coalesce(sum(CASE WHEN share >= 0.8 THEN 1 ELSE 0 END), 0) FROM "
        f"(SELECT col, avg(CASE WHEN {is_date(trimmed('v'))} THEN 1.0 ELSE 0.0 END) AS share FROM ({first_texts(source, key, texts, 20)}) GROUP BY col))) / {width}, 6) AS temporal_pattern"
    )


define(
    "H3_temporal", CLEAN + ",\n" + COMMERCE,
    " UNION ALL ".join(
        [temporal(t, t, k, [x for x in c if x in TEXTS] or ["NULL::VARCHAR"], sum(x in TIMES for x in c), len(c)) for t, (k, c) in SCHEMAS.items()]
        + [
            temporal("dirty", "clean", "_row_idx", list(COLUMNS), 0, 7),
            temporal("commerce", "commerce", "_row_idx", ["customer_id", "customer_name", "shipped", "status", "priority", "region", "nation", "segment"], 1, 14),
        ]
    ),
)
LONG = {"documents": ("doc_id", ["text", "lang", "source"], 5), "benchmark": ("item_id", ["text"], 2), "pages": ("page_id", ["url", "html"], 3)}
define(
    "H5_text_richness", "",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", round((SELECT coalesce(sum(CASE WHEN m > 50 THEN least(1.0, m / 200) ELSE 0 END), 0) FROM (SELECT col, avg(length(v)) AS m FROM ({first_texts(t, k, c, 50)}) GROUP BY col)) / {w}, 6) AS text_richness"
        for t, (k, c, w) in LONG.items()
    ),
)


def spectrum_cte(name: str, source: str, key: str, columns: list[str]) -> str:
    """The Fourier transform by its definition."""
    series = " UNION ALL ".join(
        f"SELECT '{c}' AS col, row_number() OVER (ORDER BY {key}) - 1 AS j, {c} - avg({c}) OVER () AS x, count(*) OVER () AS n FROM {source} WHERE {c} IS NOT NULL"
        for c in columns
    )
    return f"""{name}_series AS ({series}),
{name}_bins AS (SELECT col, n, unnest(range(1, n // 2)) AS k FROM (SELECT DISTINCT col, n FROM {name}_series)),
{name}_waves AS (SELECT b.col, b.n, k, sqrt(power(sum(x * cos(2 * pi() * ((j * k) % b.n) / b.n)), 2) + power(sum(x * sin(2 * pi() * ((j * k) % b.n) / b.n)), 2)) AS a
  FROM {name}_bins b JOIN {name}_series s ON s.col = b.col GROUP BY 1, 2, 3),
{name}_period AS (SELECT col, any_value(n) AS n, least(1.0, max(a) / (5 * avg(a))) AS p FROM {name}_waves GROUP BY col)"""


define("H9_periodicity", spectrum_cte("e", "events", "event_id", ["user_id", "value"]), 'SELECT col AS "column", n AS points, round(p, 6) AS periodicity FROM e_period')


def holds(source: str, parent: str, child: str) -> str:
    return f"(SELECT max(n) = 1 FROM (SELECT {child}, count(DISTINCT {parent}) AS n FROM {source} WHERE {child} IS NOT NULL GROUP BY {child}))"


def pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def hierarchy(source: str, columns: list[str]) -> str:
    every = pairs(columns)
    return "(" + " + ".join(f"CAST({holds(source, a, b)} AS INT)" for a, b in every) + f") / {len(every)}"


HIERARCHY = ["region", "nation", "segment", "status", "priority"]
define("H12_hierarchy_score", COMMERCE, f"SELECT round({hierarchy('commerce', HIERARCHY)}, 6) AS hierarchical_structure")

CUSTOMER_STATS = {
    "temporal_pattern": "0",
    "numeric_density": "2 / 6",
    "sparsity": "0",
    "categorical_presence": "(SELECT (CAST(count(DISTINCT customer_name) / count(*) < 0.3 AS INT) + CAST(count(DISTINCT region) / count(*) < 0.3 AS INT) + CAST(count(DISTINCT nation) / count(*) < 0.3 AS INT) + CAST(count(DISTINCT segment) / count(*) < 0.3 AS INT)) / 6 FROM geo)",
    "text_richness": "0",
    "high_cardinality": "(SELECT (" + " + ".join(f"CAST(count(DISTINCT {c}) / count(*) > 0.8 AS INT)" for c in CUSTOMER_COLUMNS) + ") / 6 FROM geo)",
    "distribution_skewed": mean_of([pop_skew(c, "geo") for c in ("customer_id", "balance")], 2),
    "distribution_heavy_tail": mean_of([pop_kurt(c, "geo") for c in ("customer_id", "balance")], 5),
    "periodicity": "(SELECT avg(p) FROM g_period)",
    "anomaly_presence": f"least(1.0, 10 * greatest({outliers('customer_id', 'geo')}, {outliers('balance', 'geo')}))",
    "hierarchical_structure": hierarchy("geo", ["region", "nation", "segment"]),
}
CUSTOMER_BODY = joined_text("customers", "geo", "_row_idx", CUSTOMER_COLUMNS, ["customer_name", "region", "nation", "segment"])
CUSTOMERS = GEO + ",\n" + spectrum_cte("g", "geo", "_row_idx", ["customer_id", "balance"]) + f""",
stat AS ({attribute_table(CUSTOMER_STATS, "'customers'", "(SELECT 1)")}),
bodies AS ({CUSTOMER_BODY}),
words AS (SELECT tab, {keyword_columns()} FROM bodies),
sem AS ({attribute_table({**{a: a for a in WORDS}, "relational_structure": str(key_share(CUSTOMER_COLUMNS))}, "tab", "words")}),
mixed AS (SELECT sem.tab, attribute, sem.score AS a, stat.score AS b, 0.6 * greatest(sem.score, stat.score) + 0.4 * (0.5 * sem.score + 0.5 * stat.score) AS f
  FROM sem JOIN stat USING (attribute)),
fused AS (SELECT *, 1 / (1 + exp(-3 * (f - 0.3))) AS confidence FROM mixed)"""
define("H13_statistical_scores", CUSTOMERS, 'SELECT tab AS "table", attribute, round(score, 5) AS score FROM stat')
define(
    "I1_fuse", CUSTOMERS,
    """SELECT tab AS "table", attribute, round(a, 5) AS semantic_score, round(b, 5) AS statistical_score, round(f, 5) AS raw_fused,
  round(confidence, 5) AS confidence, 'fused' AS source FROM fused WHERE confidence >= 0.15""",
)
define("I3_top_attributes", CUSTOMERS, 'SELECT tab AS "table", row_number() OVER (ORDER BY confidence DESC, attribute) AS rank, attribute FROM fused QUALIFY rank <= 5')
define("I4_above_threshold", CUSTOMERS, 'SELECT tab AS "table", attribute, round(confidence, 5) AS confidence FROM fused WHERE confidence >= 0.5')
define("I6_perceive_table", CUSTOMERS, """SELECT tab AS "table", attribute, round(round(confidence, 4), 3) AS confidence, 'fused' AS source FROM fused""")

# ---- graph ----

TYPED = COMMERCE + """,
columns AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{c}')" for i, c in enumerate(COMMERCE_COLUMNS)) + """) t(ordinal, col)),
facts AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n_rows, count({c}) AS n, count(DISTINCT {c}) AS d FROM commerce" for c in COMMERCE_COLUMNS) + """),
types AS (
  SELECT *, CASE WHEN col IN ('order_id', 'customer_id') THEN 'id' WHEN col = 'amount' THEN 'amount' WHEN col IN ('order_date', 'shipped') THEN 'datetime'
    WHEN col = 'customer_name' THEN 'name' WHEN col IN ('tax', 'rebate', 'quantity') THEN 'numeric' WHEN d / n_rows < 0.3 THEN 'categorical' ELSE 'text' END AS kind,
    CASE WHEN col IN ('order_id', 'quantity') THEN CASE col WHEN 'order_id' THEN 'int64' ELSE 'int32' END WHEN col IN ('amount', 'tax', 'rebate') THEN 'float64'
      WHEN col = 'order_date' THEN 'datetime64[ns]' ELSE 'object' END AS data_type
  FROM columns JOIN facts USING (col)
),
categories AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS v, min(_row_idx) AS seen FROM commerce WHERE {c} IS NOT NULL GROUP BY {c}" for c in ("customer_id", "customer_name", "shipped", "status", "priority", "region", "nation", "segment")
) + """),
shown AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY seen) AS r FROM categories WHERE col IN (SELECT col FROM types WHERE kind = 'categorical') QUALIFY r <= 5)"""

NUMERIC = ["order_id", "amount", "tax", "rebate", "quantity"]
CATEGORICAL = ["status", "priority", "region", "nation", "segment"]
CORR = "correlated AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM commerce" for a, b in pairs(NUMERIC)
) + "),\nheld AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {holds('commerce', a, b)} AS holds" for a, b in pairs(CATEGORICAL)) + ")"
EDGES = TYPED + ",\n" + CORR + """,
edges AS (
  SELECT 'table:commerce' AS src, 'column:' || col AS dst, 'has_column' AS relation_type, 1.0 AS weight FROM types
  UNION ALL SELECT 'column:' || col, 'value:' || col || ':' || v, 'has_value', 1.0 FROM shown
  UNION ALL SELECT 'column:order_id', 'entity:Order', 'references', 0.9
  UNION ALL SELECT 'column:customer_id', 'entity:Customer', 'references', 0.9
  UNION ALL SELECT 'column:' || a, 'column:' || b, CASE WHEN r > 0 THEN 'correlates_with' ELSE 'inversely_correlates' END, abs(r) FROM correlated WHERE abs(r) >= 0.7
  UNION ALL SELECT 'column:' || a, 'column:' || b, 'has_subcategory', 0.9 FROM held WHERE holds
  UNION ALL SELECT 'column:' || t.col, 'column:' || x.col, 'temporal_context', 0.7 FROM types t JOIN types x ON t.kind = 'datetime' AND x.kind IN ('numeric', 'amount')
)"""
define(
    "J4_graph_nodes", TYPED,
    """SELECT 'table:commerce' AS id, 'commerce' AS name, 'table' AS entity_type, NULL AS semantic_type, NULL AS null_rate, NULL AS unique_ratio, NULL AS data_type, NULL AS inferred_from
UNION ALL SELECT 'column:' || col, col, 'column', kind, CAST(CAST(round(1 - n / n_rows, 4) AS DECIMAL(6,4)) AS VARCHAR), CAST(CAST(round(d / n_rows, 4) AS DECIMAL(6,4)) AS VARCHAR), data_type, NULL FROM types
UNION ALL SELECT 'entity:Order', 'Order', 'referenced_entity', NULL, NULL, NULL, NULL, 'order_id'
UNION ALL SELECT 'entity:Customer', 'Customer', 'referenced_entity', NULL, NULL, NULL, NULL, 'customer_id'
UNION ALL SELECT 'value:' || col || ':' || v, v, 'value', NULL, NULL, NULL, NULL, NULL FROM shown""",
)
define("J7_value_nodes", TYPED, "SELECT 'value:' || col || ':' || v AS id, v AS name FROM shown")
define("J8_containment_edges", EDGES, "SELECT src, dst, relation_type, CAST(weight AS DOUBLE) AS weight FROM edges WHERE relation_type IN ('has_column', 'has_value')")
define(
    "J9_foreign_key_edges", EDGES,
    "SELECT src, dst, CAST(weight AS DOUBLE) AS weight, replace(src, 'column:', '') AS foreign_key FROM edges WHERE relation_type = 'references'",
)
define(
    "J10_correlation_edges", EDGES,
    "SELECT src, dst, relation_type, round(weight, 5) AS weight, CASE relation_type WHEN 'correlates_with' THEN 'positive' ELSE 'negative' END AS direction FROM edges WHERE relation_type LIKE '%correlates%'",
)
define("J11_hierarchy_edges", EDGES, "SELECT src, dst, relation_type, CAST(weight AS DOUBLE) AS weight FROM edges WHERE relation_type = 'has_subcategory'")
define("J12_temporal_edges", EDGES, "SELECT src, dst, CAST(weight AS DOUBLE) AS weight FROM edges WHERE relation_type = 'temporal_context'")
define(
    "J10_correlations", "",
    " UNION ALL ".join(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 5) AS r FROM lineitem" for a, b in pairs(list(LINE_NUMBERS))),
)
define(
    "J2_entity_reference",
    "n AS (SELECT p_partkey, lower(replace(p_type, ' ', '_')) AS stem FROM part), w AS (SELECT p_partkey, stem, unnest(string_split(stem, '_')) AS word, unnest(range(len(string_split(stem, '_')))) AS i FROM n)",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN string_agg(upper(word[1]) || word[2:], '' ORDER BY i) ELSE any_value(stem) END AS entity
FROM w GROUP BY p_partkey""",
)
define(
    "B4_graph_summary", EDGES,
    """SELECT 'commerce' AS graph, (SELECT 1 + 14 + 2 + (SELECT count(*) FROM shown)) AS entity_count, (SELECT count(*) FROM edges) AS relationship_count,
  'column,referenced_entity,table,value' AS entity_types, (SELECT string_agg(DISTINCT relation_type, ',' ORDER BY relation_type) FROM edges) AS relation_types""",
)
GEO_TYPED = """,
geo_shown AS (SELECT col, v FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, {c} AS v, row_number() OVER (ORDER BY min(_row_idx)) AS r, (SELECT count(DISTINCT {c}) / count(*) < 0.3 FROM geo) AS few FROM geo GROUP BY {c}" for c in ("region", "nation", "segment")
) + """) WHERE few AND r <= 5),
geo_held AS (""" + " UNION ALL ".join(f"SELECT {holds('geo', a, b)} AS holds" for a, b in pairs(["region", "nation", "segment"])) + """),
geo_edges AS (SELECT 'has_column' AS relation_type, 1.0 AS weight FROM (SELECT unnest(range(6)))
  UNION ALL SELECT 'has_value', 1.0 FROM geo_shown UNION ALL SELECT 'references', 0.9
  UNION ALL SELECT CASE WHEN r > 0 THEN 'correlates_with' ELSE 'inversely_correlates' END, abs(r) FROM (SELECT corr(CAST(customer_id AS DOUBLE), balance) AS r FROM geo) WHERE abs(r) >= 0.7
  UNION ALL SELECT 'has_subcategory', 0.9 FROM geo_held WHERE holds)"""
define(
    "J15_graph_edges", EDGES + GEO_TYPED,
    """SELECT 'commerce' AS graph, relation_type, count(*) AS edges, round(CAST(sum(weight) AS DOUBLE), 4) AS weight FROM edges GROUP BY relation_type
UNION ALL SELECT 'customers', relation_type, count(*), round(CAST(sum(weight) AS DOUBLE), 4) FROM geo_edges GROUP BY relation_type""",
)


def base_types() -> str:
    """Semantic types of the given tables; only text columns without a telling name depend on their values."""
    rows = []
    for t, (_, columns) in SCHEMAS.items():
        for c in columns:
            if c in ("event_id", "user_id", "doc_id"):
                kind, sure = "'id'", "0.9"
            elif "price" in c:
                kind, sure = "'amount'", "0.85"
            elif "date" in c:
                kind, sure = "'datetime'", "0.85"
            elif c == "ts":
                kind, sure = "'datetime'", "0.7"
            elif "name" in c:
                kind, sure = "'name'", "0.8"
            elif c in TEXTS:
                kind, sure = f"CASE WHEN (SELECT count(DISTINCT {c}) / count(*) < 0.3 FROM {t}) THEN 'categorical' ELSE 'text' END", "0.5"
            else:
                kind, sure = "'numeric'", "0.6"
            rows.append(f"SELECT '{t}' AS tab, '{c}' AS col, {kind} AS kind, {sure} AS sure")
    return " UNION ALL ".join(rows)


define(
    "J1_semantic_types", TYPED + f""",
every AS ({base_types()} UNION ALL SELECT 'commerce', col, kind, CASE kind WHEN 'id' THEN 0.9 WHEN 'amount' THEN 0.85
  WHEN 'datetime' THEN CASE col WHEN 'shipped' THEN 0.7 ELSE 0.85 END WHEN 'name' THEN 0.8 WHEN 'numeric' THEN 0.6 ELSE 0.5 END FROM types)""",
    """SELECT tab AS "table", col AS "column", kind AS semantic_type, CAST(sure AS DOUBLE) AS type_confidence, false AS is_primary_key, kind = 'id' AS is_foreign_key FROM every""",
)

# ---- streams ----

EVENT_TEXTS = {
    "event_id": "CAST(event_id AS VARCHAR)", "user_id": "CAST(user_id AS VARCHAR)", "event_type": "event_type",
    "value": "CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)", "props": "props",
}
define(
    "K1_stream_profile",
    "cells AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, {x} AS v FROM events" for c, x in EVENT_TEXTS.items()) + f"""),
hist AS (SELECT col, v, count(*) AS c FROM cells GROUP BY col, v),
facts AS (SELECT col, sum(c) AS n, count(*) AS d, sum(c * length(v)) / sum(c) AS mean_length,
  sum(CASE WHEN regexp_matches(v, '^[0-9]+$') THEN c ELSE 0 END) / sum(c) AS digits, sum(CASE WHEN regexp_matches(v, '^[a-zA-Z0-9]+$') THEN c ELSE 0 END) / sum(c) AS alnum,
  count(TRY_CAST(v AS DOUBLE)) AS castable, sum(CASE WHEN {is_date('v')} THEN c ELSE 0 END) AS dates, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM hist GROUP BY col)""",
    f'SELECT CAST(0 AS BIGINT) AS batch_id, col AS "column", CAST(0 AS DOUBLE) AS null_rate, d AS unique_count, round(entropy, 6) AS entropy, round(mean_length, 3) AS avg_length, {ID_LIKE} AS is_id_like, {TYPE} AS column_type FROM facts',
)
define(
    "K2_window_profile",
    "d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, value AS x FROM events), m AS (SELECT day, avg(x) AS mean, stddev_pop(x) AS std FROM d GROUP BY day)",
    """SELECT day, count(*) AS rows, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate, round(any_value(mean), 5) AS mean,
  round(any_value(std), 5) AS std, round(avg(power(x - mean, 3)) / power(any_value(std), 3), 4) AS skew FROM d JOIN m USING (day) GROUP BY day""",
)

# ---- documents of files, wide tables ----

define(
    "B3_result_document", H + ",\n" + CUSTOMERS.lstrip().removeprefix("WITH "),
    """SELECT 'customers' AS "table", file_id, header_row, d.confidence, needs_review, (SELECT count(*) FROM fused) AS labels,
  (SELECT string_agg(attribute, ',' ORDER BY confidence DESC, attribute) FROM (SELECT * FROM fused ORDER BY confidence DESC, attribute LIMIT 5)) AS top_attributes,
  (SELECT round(round(max(confidence), 4), 3) FROM fused) AS best FROM detected d""",
)
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_suppkey")
MIXTURES = [
    f"CAST({MEASURES[i % 5]} AS DOUBLE) * {1 + i // 5} + CAST({MEASURES[(i // 5) % 5]} AS DOUBLE) * {i % 3} + l_partkey % {i + 2}" for i in range(60)
]
define(
    "J10_wide_correlations",
    "w AS (SELECT " + ", ".join(f"CASE WHEN l_orderkey % 11 <> {i // 7} THEN {x} END AS c{i}" if i % 7 == 0 else f"{x} AS c{i}" for i, x in enumerate(MIXTURES)) + " FROM lineitem),\n"
    "p AS (SELECT unnest([" + ", ".join(f"{{'left': 'c{i}', 'right': 'c{j}', 'r': corr(c{i}, c{j})}}" for i in range(60) for j in range(i + 1, 60)) + "]) AS x FROM w)",
    """SELECT x['left'] AS "left", x['right'] AS "right", round(x['r'], 5) AS r FROM p""",
)
