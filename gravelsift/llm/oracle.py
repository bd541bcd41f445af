"""DuckDB SQL of the manifest, the shards and the ranked search."""

from __future__ import annotations

#: crc32 of a list of bytes, by the table of the reflected polynomial (a fixed value of the checksum).
CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32(data: str, table: str = "crc.t") -> str:
    """Of a list of bytes; an empty list has 0."""
    step = f"xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: {step}), 4294967295)"


#: The bytes of a string: those of its hexadecimal form, two digits each.
def string_bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"


_FIELDS = ("doc_id", "source", "lang", "n_chars")


def merkle(levels: int = 8, top_levels: int = 4) -> str:
    """Trees of eight, unrolled: up to 8 ** levels rows a language and 8 ** top_levels languages."""
    joined = lambda text: " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in (*_FIELDS, text))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"crc AS {CRC_TABLE}",
        f"d AS (SELECT *, coalesce({crc32(string_bytes('CAST(doc_id AS VARCHAR)'))} % 3 = 0, false) AS hit FROM documents, crc)",
        f"leaf AS (SELECT doc_id, lang, sha256({joined('text')}) AS h, sha256(CASE WHEN hit THEN {joined(lower)} ELSE {joined('text')} END) AS seen FROM d)",
        "a0 AS (SELECT dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, doc_id, h AS leaf, h, seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaf)",
    ]

    def up(name: str, k: int) -> None:
        low, high = f"{name}{k}", f"{name}{k + 1}"
        ctes.append(f"{high} AS (SELECT g, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (n + 7) // 8 AS n FROM {low} WHERE n > 1 GROUP BY g, i // 8, n UNION ALL SELECT g, i, h, n FROM {low} WHERE n = 1)")
        ctes.append(f"{low}s AS (SELECT x.g, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i < x.i), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (WHERE y.i > x.i), '') AS r FROM {low} x JOIN {low} y ON x.g = y.g AND x.i // 8 = y.i // 8 WHERE x.n > 1 GROUP BY x.g, x.i)")

    for k in range(levels):
        up("a", k)
    ctes.append(f"b0 AS (SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM a{levels})")
    for k in range(top_levels):
        up("b", k)
    columns, joins, fold, proof = [], [], "seen", []
    for name, count, place, group in (("a", levels, "a0.i", "a0.g"), ("b", top_levels, "a0.g", "0")):
        for k in range(count):
            s = f"{name}{k}s"
            joins.append(f"LEFT JOIN {s} ON {s}.g = {group} AND {s}.i = {place} // {8**k}")
            columns.append(f"{s}.l AS {s}l, {s}.r AS {s}r")
            proof.append(f"coalesce({s}l || {s}r, '')")
    steps = [f"p AS (SELECT a0.doc_id, a0.leaf, sub.h AS subroot, top.h AS root, a0.seen AS x, {', '.join(columns)} FROM a0 JOIN a{levels} sub ON sub.g = a0.g, b{top_levels} top {' '.join(joins)})"]
    last = "p"
    for name, count in (("a", levels), ("b", top_levels)):
        for k in range(count):
            s = f"{name}{k}s"
            steps.append(f"f{s} AS (SELECT * REPLACE (CASE WHEN {s}l IS NULL THEN x ELSE sha256({s}l || x || {s}r) END AS x) FROM {last})")
            last = f"f{s}"
    ctes += steps
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, leaf, subroot, root, sha256({' || '.join(proof)}) AS proof_sha256, x AS folded_root, x = root AS verified FROM {last}"


def shards(n: int = 8, seed: int = 42) -> str:
    return f"""
WITH crc AS {CRC_TABLE}, d AS (
    SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size, CASE WHEN text IS NOT NULL THEN {crc32(string_bytes('text'))} END AS text_crc32,
        md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(md5(text), '-')) AS mixed FROM documents, crc
), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mixed) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM d),
o AS (SELECT *, row_number() OVER (ORDER BY (rank + 0.5::DOUBLE) / n, source NULLS FIRST, rank) - 1 AS pos, count(*) OVER () AS every FROM r),
c AS (SELECT *, pos * {n} // every AS shard FROM o)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, pos - (shard * every + {n - 1}) // {n} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c
"""


RANKED = r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM t),
p AS (SELECT doc_id, row, len, term, count(*) AS tf FROM (SELECT doc_id, row_number() OVER () AS row, len(w) AS len, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM g, s),
c AS (SELECT doc_id, row, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len * n) // l))) AS c FROM p JOIN w USING (term), s),
f AS (SELECT item_id, doc_id, CAST(sum(c) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY item_id, doc_id, row),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
