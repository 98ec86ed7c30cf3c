"""Secret scanning with multipart credential linking.

Strong patterns stand on their own.  Weak parts (an identifier, an endpoint, an opaque value) are
reported only where complementary parts fall into one scope: an interval join of each part's
surroundings with the other kinds' places.  A part is no complement of what it overlaps, and an
identifier's own content is no value.  Parts of one document only ever meet parts of the same
document, so the join runs where the text was read, as a merge of sorted places, and needs no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"(?a)AKIA[A-Z0-9]+")
HEX = re.compile(r"(?a)[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

#: Weak parts. An opaque value must look random, see _opaque.
IDENTIFIER = re.compile(r"""(?ai)\b(?:user(?:name)?|login|account|client_?id|access_?key_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""")
ENDPOINT = re.compile(r"""(?ai)\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.-]+(?::[0-9]+)?)""")
OPAQUE = re.compile(r"(?a)[A-Za-z0-9+/_-]{16,}={0,2}")
#: Code points around a part within which its complements must lie.
SCOPE = 200
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "value")
#: For each weak kind, the kinds of which one each must be in scope.
NEEDS = {
    "identifier": (("assign", "access", "hex", "value"),),
    "endpoint": (("identifier", "access"), ("assign", "hex", "value")),
    "value": (("identifier", "access"),),
}

Span = tuple[int, int, str]


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def _opaque(s: str) -> bool:
    """Looks random: at least three digits, three letters and eight different characters."""
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    return digits >= 3 and letters >= 3 and len(set(s)) >= 8


def _places(found: list[tuple[int, int]]) -> np.ndarray:
    return np.array(found, np.int64).reshape(-1, 2)


def _overlaps(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each [start, end) of ``places``, whether one of ``others`` shares a code point with it."""
    starts, ends = np.sort(others[:, 0]), np.sort(others[:, 1])
    return np.searchsorted(starts, places[:, 1], "left") > np.searchsorted(ends, places[:, 0], "right")


def _beside(places: np.ndarray, others: np.ndarray, scope: int) -> np.ndarray:
    """For each [start, end) of ``places``, whether one of ``others`` lies before or behind it, fewer than ``scope`` code points away."""
    starts, ends = np.sort(others[:, 0]), np.sort(others[:, 1])
    before = np.searchsorted(ends, places[:, 0], "right") > np.searchsorted(ends, places[:, 0] - scope, "right")
    behind = np.searchsorted(starts, places[:, 1] + scope, "left") > np.searchsorted(starts, places[:, 1], "left")
    return before | behind


def spans(text: str | None, scope: int = SCOPE) -> list[Span]:
    """All spans (start, end, kind) of a text: the base ones, and weak parts whose complements are in scope."""
    text = text or ""
    found = base_spans(text)
    keyed = ":" in text or "=" in text
    weak = {
        "identifier": [m.span() for m in IDENTIFIER.finditer(text)] if keyed else [],
        "endpoint": [m.span() for m in ENDPOINT.finditer(text)] if keyed else [],
        "value": [],
    }
    if weak["identifier"] or found["access"]:
        weak["value"] = [m.span() for m in OPAQUE.finditer(text) if _opaque(m[0])]
    if any(weak.values()):
        places = {k: _places(v) for k, v in (found | weak).items()}
        base = np.concatenate([places[k] for k in KINDS[:3]])
        for k in ("identifier", "endpoint", "value"):  # what a base span covers is reported as such already
            places[k] = places[k][~_overlaps(places[k], base)]
        places["value"] = places["value"][~_overlaps(places["value"], places["identifier"])]
        for k, needs in NEEDS.items():
            ok = np.ones(len(places[k]), bool)
            for group in needs:
                ok &= _beside(places[k], np.concatenate([places[g] for g in group]), scope)
            found[k] = [tuple(x) for x in places[k][ok].tolist()]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(((a, b, k) for k, v in found.items() for a, b in v), key=lambda s: (s[0], order[s[2]]))


def join_spans(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def _scan(scope: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                all_spans = spans(t.as_py(), scope)
                base = [s for s in all_spans if s[2] in KINDS[:3]]
                n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(all_spans), len(all_spans) - len(base)))
            cols = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_linked (weak parts reported) of each row.

    Offsets are code points, ends exclusive.  Null and empty texts have no spans; null ids and
    repeated rows are kept as they are; an empty table gives an empty result; other columns are not read.
    """
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(
        _scan(scope), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _either(word: str) -> str:
    """A pattern of ASCII letters of which each may be in either case, without other letters that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _oracle() -> str:
    """SQL for the query: places of matches are found by cutting the text at them (U+E000 marks the cuts)."""
    keyed = r"""["']?\x20*[:=]\x20*["']?"""
    names = lambda *words: "(?:" + "|".join(map(_either, words)) + ")"
    patterns = {
        "assign": names("password", "passwd", "secret", "token", "api_?key") + keyed + "([A-Za-z0-9+/_.=-]+)",
        "access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)",
        "identifier": r"\b" + names("user(?:name)?", "login", "account", "client_?id", "access_?key_?id", "key_?id") + keyed + "([A-Za-z0-9+/_.@=-]{3,})",
        "endpoint": r"(\b(?:" + "|".join([*map(_either, ("https?", "ftp", "ssh")), _either("jdbc") + ":[A-Za-z]+", *map(_either, ("postgres(?:ql)?", "mysql", "mongodb", "redis", "amqps?"))])
        + r""")://[^\x20\x09-\x0D"'<>]+|\b""" + names("host", "endpoint", "server") + keyed + "[A-Za-z0-9.-]+(?::[0-9]+)?)",
        "value": "([A-Za-z0-9+/_-]{16,}={0,2})",
    }
    least = {"assign": ASSIGN_LENGTH, "access": ACCESS_LENGTH, "hex": 24}
    found = " UNION ALL ".join(
        f"SELECT rid, {k} AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', 1) AS g, string_split(regexp_replace(t, '{p}', chr(57344), 'g'), chr(57344)) AS cut FROM d"
        for k, p in enumerate(x.replace("'", "''") for x in patterns.values()))
    keep = " OR ".join(f"kind = {KINDS.index(k)} AND length(g) >= {n}" for k, n in least.items())
    digits, letters = "length(regexp_replace(m, '[^0-9]', '', 'g'))", "length(regexp_replace(m, '[^A-Za-z]', '', 'g'))"
    apart = "(y.e <= x.s OR y.s >= x.e)"
    near = f"(y.e <= x.s AND y.e > x.s - {SCOPE} OR y.s >= x.e AND y.s < x.e + {SCOPE})"
    linked = " OR ".join(
        f"x.kind = {KINDS.index(k)} AND " + " AND ".join(f"EXISTS (SELECT 1 FROM v y WHERE y.rid = x.rid AND y.kind IN ({','.join(str(KINDS.index(g)) for g in group)}) AND {near})" for group in needs)
        for k, needs in NEEDS.items())
    label = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
r AS MATERIALIZED (SELECT rid, kind, m[i] AS m, g[i] AS g, (list_sum(list_transform(cut[1:i], lambda c: length(c))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda c: length(c))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f)),
p AS MATERIALIZED (SELECT rid, kind, s, s + length(m) AS e FROM r
  WHERE {keep} OR kind IN (3, 4) OR kind = 5 AND {digits} >= 3 AND {letters} >= 3 AND len(list_distinct(string_split(m, ''))) >= 8),
u AS MATERIALIZED (SELECT * FROM p x WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM p y WHERE y.rid = x.rid AND y.kind < 3 AND NOT {apart})),
v AS MATERIALIZED (SELECT * FROM u x WHERE kind < 5 OR NOT EXISTS (SELECT 1 FROM u y WHERE y.rid = x.rid AND y.kind = 3 AND NOT {apart})),
l AS (SELECT * FROM v x WHERE kind < 3 OR {linked}),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) FILTER (kind > 2) AS more,
  string_agg({label}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({label}, ',' ORDER BY s, kind) AS spans FROM l GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(more, 0) AS n_linked
FROM d LEFT JOIN a USING (rid)"""


ORACLE = _oracle()
