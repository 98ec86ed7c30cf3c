"""SQL for the registered queries.

Where a query uses a random rotation, the SQL holds the same matrix as constants.  Principal components
hang on the data, so their constants are computed here, by singular values where the engine adds up moments,
from the table of ``VECSPARK_ORACLE_DIR``.
"""

from __future__ import annotations

import os

import numpy as np

from vecspark.functions import kernels
from vecspark.operators.compress import VARIANTS
from vecspark.plans import queries as Q

ORACLE_DIR = os.environ.get("VECSPARK_ORACLE_DIR", "/root/testdata/sf0.01")
K, D = Q.K, Q.DIM

BASE = """e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
cut AS MATERIALIZED (SELECT floor(count(*) * 0.9 + 1e-9)::BIGINT AS n FROM e),
docs AS MATERIALIZED (SELECT * FROM e WHERE vec_id < (SELECT n FROM cut)),
qs AS MATERIALIZED (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id >= (SELECT n FROM cut))"""
PAIRS = "pairs AS (SELECT query_id, vec_id, v, q FROM docs, qs)"
NORM = "sqrt(list_dot_product({0}, {0}))"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def array(row) -> str:
    return "[" + ",".join(repr(float(x)) for x in row) + "]::DOUBLE[]"


def matrix(name: str, m: np.ndarray) -> str:
    """The columns of ``m`` as a table (j, w)."""
    return f"{name}(j, w) AS MATERIALIZED (VALUES " + ",".join(f"({j}, {array(c)})" for j, c in enumerate(m.T)) + ")"


def codes(name: str, source: str, m: np.ndarray, strict: bool = False, ident: str = "vec_id", vec: str = "v") -> str:
    """CTEs that make ``name`` (ident, code) from the signs of ``source`` projected on ``m``."""
    op = ">" if strict else ">="
    return f"""{matrix(name + '_m', m)},
{name} AS MATERIALIZED (SELECT {ident}, (CASE WHEN s >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END)::BIGINT AS code
  FROM (SELECT {ident}, sum(CASE WHEN list_dot_product({vec}, w) {op} 0 THEN 1::HUGEINT << j ELSE 0::HUGEINT END) AS s FROM {source}, {name}_m GROUP BY {ident}))"""


ROT = kernels.rotation(D)
DOC_CODES = codes("dc", "docs", ROT)
QUERY_CODES = codes("qc", "qs", ROT, ident="query_id", vec="q")


def top(source: str, score: str, k: int, desc: bool = True, value: str = "score") -> str:
    """Ranks ``source`` (query_id, vec_id) by a rounded score."""
    return f"""SELECT query_id, rank, vec_id, {value} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {value} {'DESC' if desc else 'ASC'}, vec_id)::INT AS rank
  FROM (SELECT query_id, vec_id, {score} AS {value} FROM {source})) WHERE rank <= {k}"""


DOT = "round(list_dot_product(v, q), 6) + 0.0"
EXACT = f"exact AS MATERIALIZED ({top('pairs', DOT, K)})"
HAM = "bit_count(xor(code, qcode))::INT"
CODE_PAIRS = "cp AS (SELECT query_id, vec_id, dc.code AS code, qc.code AS qcode FROM dc, qc)"


def lloyd(source: str, k: int, rounds: int, p: str, where: str = "") -> str:
    """CTEs: {p}0 .. {p}{rounds} of centroids (label, c) from the first k rows, {p}a of labels (vec_id, label, d)."""
    parts = [f"{p}0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INT AS label, v AS c FROM (SELECT * FROM {source} ORDER BY vec_id LIMIT {k}))"]

    def assign(i: int, name: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT vec_id, v, label, d FROM (SELECT vec_id, v, label, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r
  FROM (SELECT vec_id, v, label, round({l2('v', 'c')}, 9) AS d FROM {source}, {p}{i})) WHERE r = 1)"""

    for i in range(rounds):
        parts += [assign(i, f"{p}a{i}"), f"""{p}m{i} AS MATERIALIZED (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM
  (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {p}a{i}) GROUP BY label, pos) GROUP BY label)""",
                  f"{p}{i + 1} AS MATERIALIZED (SELECT o.label, coalesce(n.c, o.c) AS c FROM {p}{i} o LEFT JOIN {p}m{i} n ON o.label = n.label)"]
    parts.append(assign(rounds, f"{p}a"))
    return ",\n".join(parts)


KM = lloyd("docs", Q.IVF_K, Q.ROUNDS, "km")
CENT = f"cent AS (SELECT label::BIGINT AS center_id, c FROM km{Q.ROUNDS})"
POST = "post AS (SELECT vec_id, label::BIGINT AS center_id FROM kma)"


def probe(k: int, p: str = "probe") -> str:
    return f"""{p} AS MATERIALIZED (SELECT query_id, rank, center_id FROM (SELECT query_id, center_id, row_number() OVER (PARTITION BY query_id ORDER BY d, center_id)::INT AS rank
  FROM (SELECT query_id, center_id, round({l2('c', 'q')}, 6) AS d FROM cent, qs)) WHERE rank <= {k})"""


CAND = "cand AS MATERIALIZED (SELECT DISTINCT query_id, vec_id FROM probe JOIN post USING (center_id))"
CAND_PAIRS = "pairs2 AS (SELECT query_id, vec_id, v, q FROM cand JOIN docs USING (vec_id) JOIN qs USING (query_id))"


def greedy(source: str, k: int, p: str, distance: str, value: str) -> str:
    """CTEs: {p}(center_id, vec_id, value) of farthest-first centers of ``source`` (vec_id, value); ``distance`` over a and b."""
    parts = [f"{p}c0 AS MATERIALIZED (SELECT vec_id, {value} FROM {source} ORDER BY vec_id LIMIT 1)",
             f"{p}d0 AS MATERIALIZED (SELECT s.vec_id, s.{value}, {distance.format(a='s.' + value, b='c.' + value)} AS d FROM {source} s, {p}c0 c)"]
    for i in range(1, k):
        parts += [f"{p}c{i} AS MATERIALIZED (SELECT vec_id, {value} FROM {p}d{i - 1} ORDER BY d DESC, vec_id LIMIT 1)",
                  f"{p}d{i} AS MATERIALIZED (SELECT s.vec_id, s.{value}, least(s.d, {distance.format(a='s.' + value, b='c.' + value)}) AS d FROM {p}d{i - 1} s, {p}c{i} c)"]
    parts.append(f"{p} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS center_id, vec_id, {value} FROM {p}c{i}" for i in range(k)) + ")")
    return ",\n".join(parts)


BITS = "bit_count(xor({a}, {b}))::INT"
KC = greedy("dc", Q.KCENTER_K, "kc", BITS, "code")


def slots(centers: str, n: int, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT vec_id, slot, center_id, distance FROM (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY distance, center_id) - 1)::INT AS slot
  FROM (SELECT dc.vec_id, center_id, bit_count(xor(dc.code, c.code))::INT AS distance FROM dc, {centers} c)) WHERE slot < {n})"""


def code_probe(centers: str, k: int, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT query_id, rank, center_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, center_id)::INT AS rank
  FROM (SELECT query_id, center_id, bit_count(xor(c.code, qc.code))::INT AS d FROM {centers} c, qc)) WHERE rank <= {k})"""


def two(which: str) -> str:
    t = Q.TWO
    l1, l2_ = greedy("dc", t["k1"], "one", BITS, "code"), greedy("dc", t["k2"], "two", BITS, "code")
    head = with_(BASE, DOC_CODES, QUERY_CODES, l1, l2_, slots("one", 1, "a1"), slots("two", 1, "a2"),
                 "asg AS MATERIALIZED (SELECT a1.vec_id, a1.center_id AS c1, a2.center_id AS c2 FROM a1 JOIN a2 USING (vec_id))",
                 "adj AS MATERIALIZED (SELECT DISTINCT c1, c2 FROM asg)",
                 code_probe("one", t["p1"], "s1"),
                 f"""s2 AS MATERIALIZED (SELECT query_id, c2 FROM (SELECT query_id, c2, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(two.code, qc.code)), c2) AS r
  FROM (SELECT DISTINCT query_id, c2 FROM s1 JOIN adj ON adj.c1 = s1.center_id) JOIN two ON two.center_id = c2 JOIN qc USING (query_id)) WHERE r <= {t['p2']})""")
    return head + {
        "adjacency": "SELECT c1, c2 FROM adj",
        "neighbors": """SELECT c2, rank, nbr FROM (SELECT x.center_id AS c2, y.center_id AS nbr, row_number() OVER (PARTITION BY x.center_id ORDER BY bit_count(xor(x.code, y.code)), y.center_id)::INT AS rank
  FROM two x JOIN two y ON x.center_id <> y.center_id) WHERE rank <= 4""",
        "or": "SELECT query_id, vec_id FROM s1 JOIN asg ON c1 = center_id UNION SELECT query_id, vec_id FROM s2 JOIN asg USING (c2)",
        "and": "SELECT DISTINCT query_id, vec_id FROM s1 JOIN asg ON c1 = center_id JOIN s2 USING (query_id, c2)",
    }[which]


def local(which: str) -> str:
    t = Q.LOCAL
    parts = [BASE, DOC_CODES, QUERY_CODES, greedy("dc", t["k1"], "one", BITS, "code"), slots("one", 1, "a1"),
             "mem AS MATERIALIZED (SELECT vec_id, center_id AS c1, code FROM a1 JOIN dc USING (vec_id))",
             "l0 AS MATERIALIZED (SELECT c1, vec_id, code FROM mem QUALIFY row_number() OVER (PARTITION BY c1 ORDER BY vec_id) = 1)",
             "d0 AS MATERIALIZED (SELECT mem.*, bit_count(xor(mem.code, l0.code)) AS d FROM mem JOIN l0 USING (c1))"]
    for i in range(1, t["k2"]):
        parts += [f"l{i} AS MATERIALIZED (SELECT c1, vec_id, code FROM d{i - 1} QUALIFY row_number() OVER (PARTITION BY c1 ORDER BY d DESC, vec_id) = 1 AND count(*) OVER (PARTITION BY c1) > {i})",
                  f"d{i} AS MATERIALIZED (SELECT s.vec_id, s.c1, s.code, least(s.d, coalesce(bit_count(xor(s.code, c.code)), 64)) AS d FROM d{i - 1} s LEFT JOIN l{i} c USING (c1))"]
    parts += ["inner_ AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT c1, {i} AS local, code FROM l{i}" for i in range(t["k2"])) + ")",
              "asg AS MATERIALIZED (SELECT vec_id, c1, local FROM (SELECT mem.vec_id, mem.c1, local, row_number() OVER (PARTITION BY mem.vec_id ORDER BY bit_count(xor(mem.code, i.code)), local) AS r FROM mem JOIN inner_ i USING (c1)) WHERE r = 1)",
              code_probe("one", t["p1"], "s1"),
              f"s2 AS MATERIALIZED (SELECT query_id, c1, local FROM (SELECT query_id, c1, local, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(i.code, qc.code)), rank, local) AS r FROM s1 JOIN inner_ i ON i.c1 = s1.center_id JOIN qc USING (query_id)) WHERE r <= {t['p2']})"]
    return with_(*parts) + {"or": "SELECT query_id, vec_id FROM s1 JOIN asg ON c1 = center_id", "and": "SELECT query_id, vec_id FROM s2 JOIN asg USING (c1, local)"}[which]


def chunked(rows: int, k: int, final: str) -> str:
    """K-means of each chunk, unrolled with the chunk as a key."""
    parts = [BASE, f"src AS MATERIALIZED (SELECT vec_id, v, (vec_id // {rows})::INT AS chunk FROM docs)",
             f"c0 AS MATERIALIZED (SELECT chunk, (r - 1)::INT AS label, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY vec_id) AS r FROM src) WHERE r <= {k})"]

    def assign(i: int, name: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT vec_id, v, chunk, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS r
  FROM (SELECT vec_id, v, chunk, label, round({l2('v', 'c')}, 9) AS d FROM src JOIN c{i} USING (chunk))) WHERE r = 1)"""

    for i in range(Q.ROUNDS):
        parts += [assign(i, f"a{i}"), f"""m{i} AS MATERIALIZED (SELECT chunk, label, list(x ORDER BY pos) AS c FROM (SELECT chunk, label, pos, avg(x) AS x FROM
  (SELECT chunk, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY ALL) GROUP BY ALL)""",
                  f"c{i + 1} AS MATERIALIZED (SELECT chunk, label, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} n USING (chunk, label))"]
    return with_(*parts, assign(Q.ROUNDS, "a")) + final


def recall_rows(found: str) -> str:
    return f"SELECT query_id, round(avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS recall FROM exact LEFT JOIN (SELECT DISTINCT query_id, vec_id FROM {found}) f USING (query_id, vec_id) GROUP BY query_id"


def grid(values: list[int], name: str) -> str:
    return f"grid({name}) AS (VALUES " + ",".join(f"({v}::INT)" for v in values) + ")"


def curve(bits: int | None) -> str:
    m = kernels.rotation(D, bits)
    deep = f"deep AS MATERIALIZED ({top('cp', HAM, K * max(Q.OVERSAMPLE), False, 'distance')})"
    return with_(BASE, PAIRS, EXACT, codes("dc", "docs", m), codes("qc", "qs", m, ident="query_id", vec="q"), CODE_PAIRS, deep, grid(Q.OVERSAMPLE, "oversample")) + OVERSAMPLED


OVERSAMPLED = f"""
SELECT oversample, round(avg(CASE WHEN d.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 3) AS recall FROM exact e CROSS JOIN grid
LEFT JOIN deep d ON d.query_id = e.query_id AND d.vec_id = e.vec_id AND d.rank <= {K} * oversample GROUP BY oversample"""


def hamming_sql(k: int, bits: int | None = None) -> str:
    m = kernels.rotation(D, bits)
    return with_(BASE, codes("dc", "docs", m), codes("qc", "qs", m, ident="query_id", vec="q"), CODE_PAIRS) + top("cp", HAM, k, False, "distance")


def transformed(m: np.ndarray, mean: np.ndarray | None = None, quantised: bool = False) -> str:
    """docs2 and qs2: vectors less ``mean`` times ``m``, perhaps in int8 steps."""
    x = "list_dot_product(list_transform(list_zip({v}, mean), lambda x: x[1] - x[2]), w)" if mean is not None else "list_dot_product({v}, w)"
    if quantised:
        x = f"greatest(least(round_even({x} / {2 / 256}, 0), 127), -128)"
    mean_cte = f"mu AS (SELECT {array(mean)} AS mean)" if mean is not None else "mu AS (SELECT 0 AS unused)"
    return f"""{matrix('tm', m)}, {mean_cte},
docs2 AS MATERIALIZED (SELECT vec_id, list({x.format(v='v')} ORDER BY j) AS v FROM docs, tm, mu GROUP BY vec_id),
qs2 AS MATERIALIZED (SELECT query_id, list({x.format(v='q')} ORDER BY j) AS q FROM qs, tm, mu GROUP BY query_id)"""


PAIRS2 = "p2 AS (SELECT query_id, vec_id, v, q FROM docs2, qs2)"


def documents() -> np.ndarray:
    import pyarrow.parquet as pq

    t = pq.read_table(f"{ORACLE_DIR}/embeddings.parquet", columns=["vec_id", "embedding"]).sort_by("vec_id")
    x = np.array(t.column("embedding").to_pylist(), dtype=float)
    return x[: int(len(x) * 0.9 + 1e-9)]


def principal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances) of rows by singular values; each component's largest entry is positive."""
    mean = x.mean(0)
    _, s, rows = np.linalg.svd(x - mean, full_matrices=False)
    rows *= np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]
    return mean, rows.T, s**2 / (len(x) - 1)


def half(x: str) -> str:
    """``x`` rounded to 11 significant bits, as half precision does (to 2 ** -24 below its normal range)."""
    return f"(CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / 2.0 ** (greatest(floor(log2(abs({x}))), -14) - 10), 0) * 2.0 ** (greatest(floor(log2(abs({x}))), -14) - 10) END)"


def halves(v: str) -> str:
    return f"list_transform({v}, lambda h: {half('h')})"


def int8(x: str) -> str:
    return f"greatest(least(round_even({x} / {2 / 256}, 0), 127), -128)"


def variant(name: str) -> str:
    """CTEs docs_{name}, qs_{name} (id, vector) of a variant's steps, in the order of its name."""
    precision, *steps = name.split("_")
    parts, docs, qs, x, dim = [], "docs", "qs", documents(), D
    for n, step in enumerate(steps):
        if step == "int8":
            m, mean = kernels.rotation(dim), np.zeros(dim)
            x = np.clip(np.rint(x @ m / (2 / 256)), -128, 127)
        else:
            mean, w, _ = principal(x)
            dim //= int(step[3:])
            m = w[:, :dim]
            x = (x - mean) @ m
        t = f"{name}_{n}"
        value = "list_dot_product(list_transform(list_zip({v}, mean), lambda x: x[1] - x[2]), w)"
        if step == "int8":
            value = int8("list_dot_product({v}, w)")
        parts += [matrix(f"m_{t}", m), f"mu_{t} AS (SELECT {array(mean)} AS mean)"]
        for out, source, i, v in ((f"docs_{t}", docs, "vec_id", "v"), (f"qs_{t}", qs, "query_id", "q")):
            parts.append(f"{out} AS MATERIALIZED (SELECT {i}, list({value.format(v=v)} ORDER BY j) AS {v} FROM {source}, m_{t}, mu_{t} GROUP BY {i})")
        docs, qs = f"docs_{t}", f"qs_{t}"
    v, q = (halves("v"), halves("q")) if precision == "fp16" else ("v", "q")
    return ",\n".join([*parts, f"docs_{name} AS MATERIALIZED (SELECT vec_id, {v} AS v FROM {docs})", f"qs_{name} AS MATERIALIZED (SELECT query_id, {q} AS q FROM {qs})"])


def variants() -> str:
    parts, rows = [BASE, PAIRS, EXACT], []
    for name in sorted(VARIANTS):
        parts += [variant(name), f"p_{name} AS (SELECT query_id, vec_id, v, q FROM docs_{name}, qs_{name})", f"f_{name} AS MATERIALIZED ({top('p_' + name, DOT, K)})"]
        rows.append(f"SELECT '{name}' AS variant, round(avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM exact e LEFT JOIN f_{name} f USING (query_id, vec_id)")
    return with_(*parts) + " UNION ALL ".join(rows)


def diversified() -> str:
    """The choice for p2 centers of which a fifth, at most two, come from neighbours: one seed, the nearest center."""
    t = Q.TWO
    core = max(1, int(0.8 * t["p2"]))
    budget = t["p2"] - core
    assert 0 < budget <= 2
    sql = two("and")
    at = sql.index("s2 AS MATERIALIZED")
    return sql[:at] + f"""ranked AS MATERIALIZED (SELECT query_id, c2, row_number() OVER (PARTITION BY query_id ORDER BY bit_count(xor(two.code, qc.code)), c2) AS r
  FROM (SELECT DISTINCT query_id, c2 FROM s1 JOIN adj ON adj.c1 = s1.center_id) JOIN two ON two.center_id = c2 JOIN qc USING (query_id)),
nn AS (SELECT x.center_id AS c2, y.center_id AS nbr, row_number() OVER (PARTITION BY x.center_id ORDER BY bit_count(xor(x.code, y.code)), y.center_id)::INT AS rank
  FROM two x JOIN two y ON x.center_id <> y.center_id QUALIFY rank <= 4),
fresh AS MATERIALIZED (SELECT o.query_id, o.c2 FROM ranked s JOIN nn ON s.r = 1 AND nn.c2 = s.c2 JOIN ranked o ON o.query_id = s.query_id AND o.c2 = nn.nbr AND o.r > {core}
  QUALIFY row_number() OVER (PARTITION BY o.query_id ORDER BY nn.rank) <= {budget}),
fill AS (SELECT query_id, c2, row_number() OVER (PARTITION BY query_id ORDER BY r) AS n FROM ranked ANTI JOIN fresh USING (query_id, c2) WHERE r > {core} AND r <= {2 * t['p2']}),
s2 AS MATERIALIZED (SELECT query_id, c2 FROM ranked WHERE r <= {core} UNION ALL SELECT query_id, c2 FROM fresh
  UNION ALL SELECT query_id, c2 FROM fill LEFT JOIN (SELECT query_id, count(*) AS had FROM fresh GROUP BY 1) USING (query_id) WHERE n <= {budget} - coalesce(had, 0))
SELECT DISTINCT query_id, vec_id FROM s1 JOIN asg ON c1 = center_id JOIN s2 USING (query_id, c2)"""


def tree(which: str) -> str:
    """Three levels of k-means over unit vectors, and the best-first descent: one step opens each query's nearest node."""
    t = Q.TREE
    unit = lambda v: f"list_transform({v}, lambda y: y / {NORM.format(v)})"
    level = lambda n, source, k, up: f"{up} AS MATERIALIZED (SELECT label::BIGINT AS vec_id, {unit('c')} AS v FROM {n}{Q.ROUNDS})"
    parts = [
        BASE, f"ud AS MATERIALIZED (SELECT vec_id, {unit('v')} AS v FROM docs)", f"uq AS MATERIALIZED (SELECT query_id, {unit('q')} AS q FROM qs)",
        lloyd("ud", t["n1"], Q.ROUNDS, "ka"), level("ka", "ud", t["n1"], "t1"), lloyd("t1", t["n2"], Q.ROUNDS, "kb"), level("kb", "t1", t["n2"], "t2"),
        lloyd("t2", t["n3"], Q.ROUNDS, "kc"), level("kc", "t2", t["n3"], "t3"),
        "edges AS MATERIALIZED (SELECT 1 AS level, label AS parent, vec_id::INT AS child FROM kba UNION ALL SELECT 2, label, vec_id::INT FROM kca)",
        f"""posts AS MATERIALIZED (SELECT center_id, vec_id FROM (SELECT t1.vec_id AS center_id, ud.vec_id, row_number() OVER (PARTITION BY ud.vec_id ORDER BY round({l2('ud.v', 't1.v')}, 9), t1.vec_id) AS r FROM ud, t1) WHERE r <= 2)""",
    ]
    if which == "levels":
        return with_(*parts) + "SELECT level, parent, child FROM edges"
    sizes = "SELECT center_id, count(*) AS n FROM posts GROUP BY 1"
    if which == "postings":
        return with_(*parts) + sizes
    parts += [
        f"sizes AS MATERIALIZED ({sizes})",
        "nodes AS MATERIALIZED (SELECT 1 AS level, vec_id::INT AS id, v FROM t1 UNION ALL SELECT 2, vec_id::INT, v FROM t2 UNION ALL SELECT 3, vec_id::INT, v FROM t3)",
        "far AS MATERIALIZED (SELECT query_id, level, id, round(1 - list_dot_product(v, q), 9) AS d FROM nodes, uq)",
        "kids AS MATERIALIZED (SELECT f.query_id, e.level + 1 AS level, e.parent AS id, list({'d': f.d, 'level': f.level, 'id': f.id}) AS items FROM edges e JOIN far f ON f.level = e.level AND f.id = e.child GROUP BY ALL)",
        f"""walk AS (
  SELECT query_id, 0 AS step, list_sort(list({{'d': d, 'level': level, 'id': id}})) AS heap, NULL::INT AS leaf, 0::BIGINT AS held, 0 AS l3_opened, 0 AS l2_pool, 0 AS l2_opened, 0 AS l1_pool, 0 AS l1_opened
  FROM far WHERE level = 3 GROUP BY query_id
  UNION ALL
  SELECT w.query_id, step + 1, list_sort(list_concat(w.heap[2:], coalesce(k.items, []))), CASE WHEN w.heap[1].level = 1 THEN w.heap[1].id END, held + coalesce(s.n, 0),
    l3_opened + (w.heap[1].level = 3)::INT, l2_pool + CASE WHEN w.heap[1].level = 3 THEN len(coalesce(k.items, [])) ELSE 0 END, l2_opened + (w.heap[1].level = 2)::INT,
    l1_pool + CASE WHEN w.heap[1].level = 2 THEN len(coalesce(k.items, [])) ELSE 0 END, l1_opened + (w.heap[1].level = 1)::INT
  FROM walk w LEFT JOIN kids k ON k.query_id = w.query_id AND k.level = w.heap[1].level AND k.id = w.heap[1].id LEFT JOIN sizes s ON w.heap[1].level = 1 AND s.center_id = w.heap[1].id
  WHERE len(w.heap) > 0 AND held < {t['beam']})""",
        "found AS MATERIALIZED (SELECT DISTINCT query_id, vec_id FROM walk JOIN posts ON posts.center_id = walk.leaf)",
    ]
    if which == "stats":
        return with_(*parts, recursive=True) + """SELECT query_id, l3_opened::INT AS l3_opened, l2_pool::INT AS l2_pool, l2_opened::INT AS l2_opened, l1_pool::INT AS l1_pool, l1_opened::INT AS l1_opened, step::INT AS popped, candidates
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step DESC) AS r FROM walk) JOIN (SELECT query_id, count(*) AS candidates FROM found GROUP BY 1) USING (query_id) WHERE r = 1"""
    return with_(*parts, "fp AS (SELECT query_id, vec_id, ud.v, uq.q FROM found JOIN ud USING (vec_id) JOIN uq USING (query_id))", recursive=True) + top("fp", DOT, K)


def wide(source: str, ident: str, vec: str, name: str) -> str:
    """Codes of vectors lengthened to more than 64 numbers: (ident, lo, hi)."""
    m = kernels.rotation(Q.WIDE)
    word = "(CASE WHEN {0} >= 9223372036854775808::HUGEINT THEN {0} - 18446744073709551616::HUGEINT ELSE {0} END)::BIGINT"
    part = lambda a, b: f"sum(CASE WHEN j >= {a} AND j < {b} AND p >= 0 THEN 1::HUGEINT << (j - {a}) ELSE 0::HUGEINT END)"
    return f"""{matrix(name + '_m', m)},
{name} AS MATERIALIZED (SELECT {ident}, {word.format('lo')} AS lo, {word.format('hi')} AS hi FROM (SELECT {ident}, {part(0, 64)} AS lo, {part(64, Q.WIDE)} AS hi
  FROM (SELECT {ident}, j, list_dot_product(list_concat({vec}, {vec}[1:{Q.WIDE - D}]), w) AS p FROM {source}, {name}_m) GROUP BY {ident}))"""


def random_values(normal: bool, n: int = 1000, dim: int = 8) -> str:
    """Random values as constants, from XXH64 of the id, the position, the seed 0 and a salt, each hash the seed of the next."""
    import xxhash

    def uniform(i: int, d: int, salt: int) -> float:
        h = 42
        for part in (i.to_bytes(8, "little"), d.to_bytes(4, "little"), bytes(4), salt.to_bytes(4, "little")):
            h = xxhash.xxh64_intdigest(part, h)
        return (h % (1 << 52) + 0.5) / (1 << 52)

    u, w = (np.array([[uniform(i, d, salt) for d in range(dim)] for i in range(n)]) for salt in (1, 2))
    x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * w) if normal else u
    rows = ",".join(f"({i},{d},{float(x[i, d])!r},{float(x[:, d].mean())!r},{float(x[:, d].std(ddof=1))!r})" for i in range(50) for d in range(dim))
    return f"SELECT i::BIGINT AS vec_id, d::INT AS pos, round(x::DOUBLE, 9) + 0.0 AS x, round(m::DOUBLE, 6) + 0.0 AS mean, round(s::DOUBLE, 6) + 0.0 AS spread FROM (VALUES {rows}) t(i, d, x, m, s)"


def oracles() -> dict[str, str]:
    pos = "SELECT vec_id, (pos - 1)::INT AS pos, round({0}, 6) + 0.0 AS x FROM (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM (SELECT vec_id, {1} AS x FROM {2}))"
    s = {
        "scan_split": with_(BASE) + "SELECT 'docs' AS part, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM docs UNION ALL SELECT 'queries', count(*), min(query_id), max(query_id) FROM qs",
        "chunk_range": f"SELECT (vec_id // {Q.CHUNK_ROWS})::INT AS chunk, count(*) AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1",
        "vec_norms": with_(BASE) + f"SELECT vec_id, round({NORM.format('v')}, 6) + 0.0 AS norm FROM e",
        "row_normalize": with_(BASE) + pos.format("x", f"list_transform(v, lambda y: y / {NORM.format('v')})", "e"),
        "global_norm": with_(BASE, "t AS (SELECT sqrt(sum(list_dot_product(v, v))) AS n FROM e)") + f"SELECT vec_id, round({NORM.format('v')} / n, 9) + 0.0 AS norm FROM e, t",
        "dot_pairs": with_(BASE, PAIRS) + f"SELECT query_id, vec_id, {DOT} AS score FROM pairs",
        "l2_pairs": with_(BASE, PAIRS) + f"SELECT query_id, vec_id, round({l2('v', 'q')}, 6) + 0.0 AS distance FROM pairs",
        "unitnorm_l2": with_(BASE, PAIRS) + "SELECT query_id, vec_id, round(2 - 2 * list_dot_product(v, q), 6) + 0.0 AS distance FROM pairs",
        "cosine_distance": with_(BASE, PAIRS) + f"SELECT query_id, vec_id, round(1 - list_dot_product(v, q) / ({NORM.format('v')} * {NORM.format('q')}), 6) + 0.0 AS distance FROM pairs",
        "vector_functions": with_(BASE, "m AS (SELECT count(*) AS m FROM qs)") + f"SELECT query_id, vec_id, {DOT} AS dot, round({l2('v', 'q')}, 6) + 0.0 AS l2, round(2 - 2 * list_dot_product(v, q), 6) + 0.0 AS unit_l2, round(1 - list_dot_product(v, q) / ({NORM.format('v')} * {NORM.format('q')}), 6) + 0.0 AS cosine_distance FROM docs, m, cut JOIN qs ON query_id = vec_id % m + n",
        "dim_means": with_(BASE) + "SELECT (pos - 1)::INT AS pos, round(avg(x), 9) + 0.0 AS mean FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY pos",
        "center_vectors": with_(BASE, "u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e)") + "SELECT vec_id, (pos - 1)::INT AS pos, round(x - avg(x) OVER (PARTITION BY pos), 6) + 0.0 AS x FROM u",
        "exact_topk_ip": with_(BASE, PAIRS) + top("pairs", DOT, K),
        "exact_topk_cosine": with_(BASE, PAIRS) + top("pairs", f"round(list_dot_product(v, q) / ({NORM.format('v')} * {NORM.format('q')}), 6) + 0.0", K),
        "exact_topk_l2": with_(BASE, PAIRS) + top("pairs", f"round({l2('v', 'q')}, 6) + 0.0", K, False),
        "topk_clamped": with_(BASE) + "SELECT d.vec_id AS query_id, count(*) AS n, count(*)::INT AS last_rank FROM docs d, qs GROUP BY 1",
        "rotate": with_(BASE, matrix("m", ROT)) + "SELECT vec_id, j AS pos, round(list_dot_product(v, w), 6) + 0.0 AS x FROM e, m",
        "int8_quantize": with_(BASE, matrix("m", ROT)) + f"SELECT vec_id, j AS pos, greatest(least(round_even(list_dot_product(v, w) / {2 / 256}, 0), 127), -128)::INT AS q FROM e, m",
        "int8_topk": with_(BASE, transformed(ROT, quantised=True), PAIRS2) + top("p2", DOT, K),
        "sign_codes": with_(BASE, codes("c", "e", ROT)) + "SELECT vec_id, code FROM c",
        "sign_codes_strict": with_(BASE, codes("c", "e", ROT, True)) + "SELECT vec_id, code FROM c",
        "quant_error": with_(BASE, matrix("m", ROT)) + f"SELECT vec_id, round(sqrt(sum((p - CASE WHEN p >= 0 THEN 1.0 ELSE -1.0 END) ** 2)) / sqrt({D}.0), 6) + 0.0 AS error FROM (SELECT vec_id, list_dot_product(v, w) AS p FROM e, m) GROUP BY vec_id",
        "hamming_pairs": with_(BASE, DOC_CODES, QUERY_CODES, CODE_PAIRS) + f"SELECT query_id, vec_id, {HAM} AS distance FROM cp",
        "hamming_topk": hamming_sql(K),
        "hamming_oversample": hamming_sql(K * max(Q.OVERSAMPLE)),
        "lsh_topk": hamming_sql(K, Q.LSH_BITS[1]),
        "binary_recall_curve": curve(None),
        "lsh_recall_curve": curve(Q.LSH_BITS[1]),
        "binary_rerank": with_(BASE, DOC_CODES, QUERY_CODES, CODE_PAIRS, f"cand AS ({top('cp', HAM, 5 * K, False, 'distance')})", CAND_PAIRS) + top("pairs2", DOT, K),
        "recall_at_k": with_(BASE, PAIRS, EXACT, DOC_CODES, QUERY_CODES, CODE_PAIRS, f"found AS ({top('cp', HAM, K, False, 'distance')})") + recall_rows("found"),
        "recall_oversample": with_(BASE, PAIRS, EXACT, DOC_CODES, QUERY_CODES, CODE_PAIRS, f"found AS ({top('cp', HAM, 5 * K, False, 'distance')})") + recall_rows("found").replace(", 6) + 0.0 AS recall", ", 3) + 0.0 AS recall"),
        "kmeans_lloyd_fixed": with_(BASE, KM) + f"SELECT label, (pos - 1)::INT AS pos, round(x, 6) + 0.0 AS x FROM (SELECT label, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM km{Q.ROUNDS})",
        "kmeans_inertia": with_(BASE, KM) + "SELECT round(sum(d), 6) + 0.0 AS inertia FROM kma",
        "ivf_assign": with_(BASE, KM) + "SELECT vec_id, label FROM kma",
        "ivf_list_offsets": with_(BASE, KM) + "SELECT label, n, coalesce(sum(n) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM (SELECT label, count(*) AS n FROM kma GROUP BY label)",
        "ivf_probe_float": with_(BASE, KM, CENT, probe(4)) + "SELECT * FROM probe",
        "ivf_probe_binary": with_(BASE, KM, codes("cc", f"(SELECT label::BIGINT AS center_id, c FROM km{Q.ROUNDS})", ROT, ident="center_id", vec="c"), QUERY_CODES, code_probe("cc", 4, "probe")) + "SELECT * FROM probe",
        "ivf_candidates": with_(BASE, KM, CENT, POST, probe(4), CAND) + "SELECT * FROM cand",
        "ivf_rerank": with_(BASE, KM, CENT, POST, probe(4), CAND, CAND_PAIRS) + top("pairs2", DOT, K),
        "ivf_recall_curve": with_(BASE, PAIRS, EXACT, KM, CENT, POST, probe(max(Q.IVF_STEPS)), grid(Q.IVF_STEPS, "top"), "wide AS MATERIALIZED (SELECT DISTINCT top, query_id, vec_id FROM probe JOIN grid ON rank <= top JOIN post USING (center_id))") + "SELECT top, round(avg(CASE WHEN w.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS recall FROM exact CROSS JOIN grid LEFT JOIN wide w USING (top, query_id, vec_id) GROUP BY top",
        "candidate_share": with_(BASE, KM, CENT, POST, probe(4), CAND) + "SELECT query_id, count(c.vec_id) AS n_candidates, round(count(c.vec_id) * 100.0 / (SELECT count(*) FROM docs), 6) AS share FROM qs LEFT JOIN cand c USING (query_id) GROUP BY query_id",
        "recall_quantiles": with_(BASE, PAIRS, EXACT, KM, CENT, POST, probe(4), CAND, f"r AS ({recall_rows('cand').replace('round(avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 6) + 0.0', 'avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END)')})") + "SELECT round(quantile_cont(recall, 0.1), 6) AS p10, round(quantile_cont(recall, 0.5), 6) AS p50, round(quantile_cont(recall, 0.95), 6) AS p95, round(avg(recall), 6) AS mean FROM r",
        "share_histogram": with_(BASE, KM, CENT, POST, probe(4), CAND, "sh AS (SELECT query_id, round(count(c.vec_id) * 100.0 / (SELECT count(*) FROM docs), 6) AS share FROM qs LEFT JOIN cand c USING (query_id) GROUP BY query_id)") + "SELECT least(floor(greatest(0, least(100, share)) * 20 / 100.0), 19)::INT AS bin, count(*) AS n FROM sh GROUP BY 1",
        "chunked_ivf": chunked(Q.CHUNK_ROWS, Q.CHUNK_K, f"SELECT vec_id, (chunk * {Q.CHUNK_K} + label)::INT AS center_id FROM a"),
        "sharded_cluster_sizes": chunked(225, 8, "SELECT chunk AS shard, label AS cluster, count(*) AS n FROM a GROUP BY 1, 2"),
        "kcenter_hamming": with_(BASE, DOC_CODES, KC) + "SELECT center_id, vec_id FROM kc",
        "kcenter_l2": with_(BASE, greedy("docs", Q.KCENTER_K, "kc", "round(" + l2("{a}", "{b}") + ", 9)", "v")) + "SELECT center_id, vec_id FROM kc",
        "kcenter_distinct": with_(BASE, DOC_CODES, KC) + "SELECT count(*) AS centers, count(DISTINCT code) AS distinct_centers FROM kc",
        "kcenter_assign_top1": with_(BASE, DOC_CODES, KC, slots("kc", 1, "a")) + "SELECT * FROM a",
        "kcenter_assign_topL": with_(BASE, DOC_CODES, KC, slots("kc", Q.KCENTER_SLOTS, "a")) + "SELECT * FROM a",
        "kcenter_sizes": with_(BASE, DOC_CODES, KC, slots("kc", 1, "a")) + "SELECT center_id, count(*) AS n FROM a GROUP BY 1",
        "kcenter_majority": with_(BASE, DOC_CODES, KC, slots("kc", 1, "a"), "b AS (SELECT center_id, j, sum((code >> j) & 1) * 2 >= count(*) AS bit FROM a JOIN dc USING (vec_id), range(64) t(j) GROUP BY 1, 2)") + "SELECT center_id, (CASE WHEN s >= 9223372036854775808::HUGEINT THEN s - 18446744073709551616::HUGEINT ELSE s END)::BIGINT AS code FROM (SELECT center_id, sum(CASE WHEN bit THEN 1::HUGEINT << j::INT ELSE 0::HUGEINT END) AS s FROM b GROUP BY 1)",
        "kcenter_probe": with_(BASE, DOC_CODES, QUERY_CODES, KC, slots("kc", Q.KCENTER_SLOTS, "post"), code_probe("kc", Q.KCENTER_TOP, "probe"), CAND) + "SELECT * FROM cand",
        "kcenter_recall": with_(BASE, PAIRS, EXACT, DOC_CODES, QUERY_CODES, KC, slots("kc", Q.KCENTER_SLOTS, "post"), code_probe("kc", Q.KCENTER_TOP, "probe"), CAND) + recall_rows("cand"),
        "two_layer_adjacency": two("adjacency"), "two_layer_neighbors": two("neighbors"), "two_layer_or": two("or"), "two_layer_and": two("and"),
        "local_l2_or": local("or"), "local_l2_and": local("and"),
        "knn_graph": with_(BASE, DOC_CODES) + f"SELECT vec_id, rank, nbr, distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nbr)::INT AS rank FROM (SELECT a.vec_id, b.vec_id AS nbr, bit_count(xor(a.code, b.code))::INT AS distance FROM dc a JOIN dc b ON a.vec_id <> b.vec_id)) WHERE rank <= {Q.GRAPH_M}",
    }
    for bits in Q.LSH_BITS:
        s[f"lsh_codes_{bits}"] = with_(BASE, codes("c", "e", kernels.rotation(D, bits))) + "SELECT vec_id, code FROM c"
    mean = "mu AS (SELECT list(x ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM docs) GROUP BY pos))"
    centred = "round(list_dot_product(list_transform(list_zip(v, mean), lambda x: x[1] - x[2]), list_transform(list_zip(q, mean), lambda x: x[1] - x[2])), 6) + 0.0"
    s["pca_topk_full"] = with_(BASE, mean, "pm AS (SELECT query_id, vec_id, v, q, mean FROM docs, qs, mu)") + top("pm", centred, K)
    if os.path.exists(f"{ORACLE_DIR}/embeddings.parquet"):
        n = D // Q.PCA_FACTOR
        x = documents()
        mean_, w, variance = principal(x)
        small = transformed(w[:, :n], mean_)
        s["pca_topk"] = with_(BASE, small, PAIRS2) + top("p2", DOT, K)
        s["pca_explained"] = "SELECT component, round(variance, 9) + 0.0 AS variance FROM (VALUES " + ",".join(f"({i}::INT, {float(v)!r}::DOUBLE)" for i, v in enumerate(variance)) + ") t(component, variance)"
        s["pca_recall_curve"] = with_(BASE, PAIRS, EXACT, small, PAIRS2, f"deep AS MATERIALIZED ({top('p2', DOT, K * max(Q.OVERSAMPLE))})", grid(Q.OVERSAMPLE, "oversample")) + OVERSAMPLED
        r = kernels.rotation(n)
        s["pca_binary_topk"] = with_(BASE, small, codes("dc", "docs2", r), codes("qc", "qs2", r, ident="query_id", vec="q"), CODE_PAIRS) + top("cp", HAM, K, False, "distance")
        for name, key in (("fp16", "fp16_topk"), ("fp32_int8_pca4", "int8_pca_topk")):
            s[key] = with_(BASE, variant(name), f"pv AS (SELECT query_id, vec_id, v, q FROM docs_{name}, qs_{name})") + top("pv", DOT, K)
        s["variant_matrix"] = variants()
    s["byte_codes"] = with_(BASE, "u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS j FROM e)", "b AS (SELECT vec_id, j // 8 AS n, sum(CASE WHEN x > 0 THEN 1 << (7 - (j % 8))::INT ELSE 0 END)::INT AS byte FROM u GROUP BY 1, 2)") + "SELECT vec_id, string_agg(printf('%02X', byte), '' ORDER BY n) AS code FROM b GROUP BY vec_id"
    s["random_uniform"], s["random_normal"] = random_values(False), random_values(True)
    s["rotated_kmeans"] = s["ivf_assign"]
    s["fp16_roundtrip"] = with_(BASE) + f"SELECT vec_id, (pos - 1)::INT AS pos, {half('x')} AS x FROM (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e)"
    s["ivf_saved_search"], s["kcenter_many_passes"], s["csv_results"] = s["ivf_rerank"], s["kcenter_hamming"], s["hamming_topk"]
    s["graph_search"] = s["graph_search_shards"] = hamming_sql(Q.GRAPH_TOP)
    center_codes = codes("cc", f"(SELECT label::BIGINT AS center_id, c FROM km{Q.ROUNDS})", ROT, ident="center_id", vec="c")
    s["ivf_recall_curve_binary"] = s["ivf_recall_curve"].replace(probe(max(Q.IVF_STEPS)), ",\n".join((center_codes, QUERY_CODES, code_probe("cc", max(Q.IVF_STEPS), "probe"))))
    s["global_kmeans"] = with_(BASE, "g AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda y: y / t) AS v FROM docs, (SELECT sqrt(sum(list_dot_product(v, v))) AS t FROM docs))", lloyd("g", Q.IVF_K, Q.ROUNDS, "km")) + "SELECT vec_id, label FROM kma"
    s["chunked_ivf_search"] = chunked(Q.CHUNK_ROWS, Q.CHUNK_K, ",\n" + ",\n".join((
        codes("cc", f"(SELECT (chunk * {Q.CHUNK_K} + label)::BIGINT AS center_id, c FROM c{Q.ROUNDS})", ROT, ident="center_id", vec="c"), QUERY_CODES, code_probe("cc", Q.IVF_PROBES, "probe"),
        f"found AS (SELECT query_id, a.vec_id, v, q FROM probe JOIN a ON a.chunk * {Q.CHUNK_K} + a.label = center_id JOIN qs USING (query_id))")) + "\n" + top("found", DOT, K))
    s["two_layer_diversified"] = diversified()
    s |= {f"kmeans_tree_{k}": tree(k) for k in ("levels", "postings", "search")} | {"tree_stats": tree("stats")}
    words = "SELECT vec_id, word, bits FROM (SELECT vec_id, 0 AS word, lo AS bits FROM c UNION ALL SELECT vec_id, 1, hi FROM c)"
    s["wide_codes"] = with_(BASE, wide("e", "vec_id", "v", "c")) + words
    far = "(bit_count(xor({a}.lo, {b}.lo)) + bit_count(xor({a}.hi, {b}.hi)))::INT"
    s["wide_hamming_topk"] = with_(BASE, wide("docs", "vec_id", "v", "dc"), wide("qs", "query_id", "q", "qc"), "cp AS (SELECT query_id, vec_id, " + far.format(a="dc", b="qc") + " AS d FROM dc, qc)") + top("cp", "d", K, False, "distance")
    longer = lambda v: f"list_concat({v}, {v}[1:{Q.WIDE - D}])"
    mean = "SELECT '{0}' AS provider, round(avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM {1} LEFT JOIN {2} f USING (query_id, vec_id)"
    s["provider_recall"] = with_(
        BASE, PAIRS, EXACT, DOC_CODES, QUERY_CODES, CODE_PAIRS, f"found AS ({top('cp', HAM, K, False, 'distance')})", wide("docs", "vec_id", "v", "wd"), wide("qs", "query_id", "q", "wq"),
        "wp AS (SELECT query_id, vec_id, " + far.format(a="wd", b="wq") + " AS d FROM wd, wq)", f"wfound AS ({top('wp', 'd', K, False, 'distance')})",
        f"wpairs AS (SELECT query_id, vec_id, {longer('v')} AS v, {longer('q')} AS q FROM docs, qs)", f"wexact AS MATERIALIZED ({top('wpairs', DOT, K)})",
    ) + mean.format("default", "exact", "found") + " UNION ALL " + mean.format("wide", "wexact", "wfound")
    both = "(bit_count(xor({a}.lo, {b}.lo)) + bit_count(xor({a}.hi, {b}.hi)))::INT"
    s["wide_kcenter"] = with_(BASE, wide("docs", "vec_id", "v", "w"), "dc AS MATERIALIZED (SELECT vec_id, {'lo': lo, 'hi': hi} AS code FROM w)", greedy("dc", Q.KCENTER_K, "kc", both, "code")) + "SELECT center_id, vec_id FROM kc"
    s["stored_clusters"] = chunked(225, 8, f""", near AS MATERIALIZED (SELECT query_id, chunk, label FROM (SELECT query_id, chunk, label, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk * 8 + label) AS r
  FROM (SELECT query_id, chunk, label, round(list_dot_product(c, q), 6) AS s FROM c{Q.ROUNDS}, qs)) WHERE r <= 2),
found AS (SELECT query_id, vec_id, v, q FROM near JOIN a USING (chunk, label) JOIN qs USING (query_id)) """ + top("found", DOT, K))
    ip_probe = probe(2, "probe_ip").replace(f"round({l2('c', 'q')}, 6)", "-round(list_dot_product(c, q), 6)")
    pick = "{0} AS MATERIALIZED (SELECT DISTINCT query_id, vec_id FROM {1} JOIN post USING (center_id))"
    s["union_and_intersection"] = with_(BASE, KM, CENT, POST, probe(2), ip_probe, pick.format("x", "probe"), pick.format("y", "probe_ip"),
        "u AS (SELECT query_id, count(*) AS appended, count(DISTINCT vec_id) AS in_either FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1)",
        "i AS (SELECT query_id, count(*) AS in_both FROM (SELECT * FROM x INTERSECT SELECT * FROM y) GROUP BY 1)") + "SELECT query_id, appended, in_either, coalesce(in_both, 0) AS in_both FROM u LEFT JOIN i USING (query_id)"
    for name in ("and", "or"):
        sql = two(name)
        at = sql.rindex("\nSELECT") if name == "and" else sql.rindex("\nSELECT query_id, vec_id FROM s1")
        q = lambda c: f"round(quantile_cont({c}, 0.1), 6) AS {c}_p10, round(quantile_cont({c}, 0.5), 6) AS {c}_p50, round(quantile_cont({c}, 0.95), 6) AS {c}_p95, round(avg({c}), 6) AS {c}_mean"
        exact5 = top("pairs", f"round(list_dot_product(v, q) / ({NORM.format('v')} * {NORM.format('q')}), 6) + 0.0", 5)
        s[f"cascade_report_{name}"] = sql[:at] + f""",
cand AS MATERIALIZED ({sql[at + 1:]}), {PAIRS}, exact AS MATERIALIZED ({exact5}),
sh AS (SELECT query_id, round(count(c.vec_id) * 100.0 / (SELECT count(*) FROM docs), 6) AS share FROM qs LEFT JOIN cand c USING (query_id) GROUP BY query_id),
rc AS (SELECT query_id, avg(CASE WHEN f.vec_id IS NULL THEN 0.0 ELSE 1.0 END) AS recall FROM exact LEFT JOIN cand f USING (query_id, vec_id) GROUP BY query_id)
SELECT * FROM (SELECT {q('share')} FROM sh), (SELECT {q('recall')} FROM rc)"""
    return s
