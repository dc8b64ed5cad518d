"""DuckDB SQL of the queries that SQL can express; only the correctness check
reads it.  The tables have a unique doc_id."""

from __future__ import annotations

from memscan.llm.sharding import OVERHEAD, SALTS, SLOTS

#: table of the CRC-32 polynomial, then a checksum over a list of byte values
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab)"""
WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text; needs ``crc_table`` in FROM."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}),"
            f" lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)")


def virtual_slots(n: int = 24) -> str:
    """op11: slots dealt in turn; each shard keeps its largest slots up to the
    mean, the rest goes, largest first, to the least loaded shard."""
    return f"""WITH RECURSIVE {CRC_TABLE},
    rec AS (SELECT doc_id, (strlen(coalesce(text, '')) + {OVERHEAD})::BIGINT AS size,
                   {crc32("coalesce(text, '')")} AS text_crc32,
                   ({crc32("doc_id::VARCHAR")} % {SLOTS})::INTEGER AS virtual_slot FROM documents, crc_table),
    slots AS (SELECT virtual_slot, sum(size)::BIGINT AS bytes, virtual_slot % {n} AS home FROM rec GROUP BY ALL),
    ordered AS (SELECT *, row_number() OVER w AS rn, sum(bytes) OVER w * {n} <= sum(bytes) OVER () AS fits
                FROM slots WINDOW w AS (PARTITION BY home ORDER BY bytes DESC, virtual_slot)),
    stays AS (SELECT *, fits OR rn = 1 AS stay FROM ordered),
    pool AS (SELECT virtual_slot, bytes, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS k FROM stays WHERE NOT stay),
    kept_load AS (SELECT i AS home, coalesce(sum(bytes), 0)::BIGINT AS load FROM range({n}) r(i)
                  LEFT JOIN (SELECT * FROM stays WHERE stay) s ON s.home = r.i GROUP BY i),
    dealt AS (SELECT 0::BIGINT AS k, -1::BIGINT AS virtual_slot, -1::BIGINT AS shard, list(load ORDER BY home) AS loads FROM kept_load
        UNION ALL
        SELECT p.k, p.virtual_slot, list_position(d.loads, list_min(d.loads)) - 1,
               list_transform(d.loads, lambda x, i: CASE WHEN i = list_position(d.loads, list_min(d.loads))
                                                         THEN x + p.bytes ELSE x END)
        FROM dealt d JOIN pool p ON p.k = d.k + 1),
    shard_of AS (SELECT virtual_slot, home AS shard FROM stays WHERE stay
                 UNION ALL SELECT virtual_slot, shard FROM dealt WHERE k > 0)
    SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
           (row_number() OVER (PARTITION BY shard ORDER BY rec.virtual_slot, text_crc32 % {SALTS}, doc_id) - 1)::BIGINT AS slot,
           NULL::INTEGER AS grown_shard, rec.virtual_slot AS virtual_slot, 1::INTEGER AS map_version
    FROM rec JOIN shard_of s ON s.virtual_slot = rec.virtual_slot"""


def merkle(fanout: int = 16, levels: int = 8) -> str:
    """op12: trees level by level, each node with the siblings of its run; a
    tree that has its root stays as it is on the levels above (16^8 leaves)."""
    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    up = "abcdefghijklmnopqrstuvwxyz"
    parts = [f"""WITH {CRC_TABLE},
    leaves AS (SELECT doc_id, source, {leaf("text")} AS leaf,
               CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0
                    THEN {leaf(f"translate(text, '{up.upper()}', '{up}')")} ELSE {leaf("text")} END AS tampered
               FROM documents, crc_table),
    trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
              FROM (SELECT DISTINCT source FROM leaves)),
    a0 AS (SELECT doc_id, tree, leaf, tampered, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS rank
           FROM leaves JOIN trees ON leaves.source IS NOT DISTINCT FROM trees.source)"""]

    def climb(tag: str, first: str) -> str:
        """Levels of the trees in ``first`` (tree, rank, digest); ``{tag}0`` .. as (tree, rank, digest, n)."""
        parts.append(f"{tag}0 AS (SELECT tree, rank, digest, count(*) OVER (PARTITION BY tree) AS n FROM ({first}))")
        for h in range(levels):
            parts.append(f"""{tag}g{h} AS (SELECT tree, rank // {fanout} AS run, any_value(n) AS n,
                list(digest ORDER BY rank) AS kids FROM {tag}{h} GROUP BY ALL)""")
            parts.append(f"""{tag}{h + 1} AS (SELECT tree, run AS rank, CASE WHEN n = 1 THEN kids[1]
                ELSE sha256(list_aggregate(kids, 'string_agg', '')) END AS digest,
                ((n + {fanout - 1}) // {fanout})::BIGINT AS n FROM {tag}g{h})""")
        return f"{tag}{levels}"

    sub = climb("s", "SELECT tree, rank, leaf AS digest FROM a0")
    top = climb("t", f"SELECT 0 AS tree, tree AS rank, digest FROM {sub}")
    # walk up from each leaf: place = rank on the level, got = recomputed digest, proof = siblings so far
    parts.append("""w_s0 AS (SELECT doc_id, tree AS src, tree, leaf, rank AS place, tampered AS got, '' AS proof FROM a0)""")
    last = "w_s0"
    for tag in ("s", "t"):
        if tag == "t":
            parts.append(f"w_t0 AS (SELECT doc_id, src, 0 AS tree, leaf, src AS place, got, proof FROM {last})")
        for h in range(levels):
            i = f"(place % {fanout})::BIGINT"
            parts.append(f"""w_{tag}{h + 1} AS (SELECT doc_id, src, w.tree AS tree, leaf, place // {fanout} AS place,
                CASE WHEN n = 1 THEN got ELSE sha256(coalesce(list_aggregate(kids[:{i}], 'string_agg', ''), '') || got ||
                     coalesce(list_aggregate(kids[{i} + 2:], 'string_agg', ''), '')) END AS got,
                CASE WHEN n = 1 THEN proof ELSE proof || coalesce(list_aggregate(kids[:{i}], 'string_agg', ''), '') ||
                     coalesce(list_aggregate(kids[{i} + 2:], 'string_agg', ''), '') END AS proof
                FROM w_{tag}{h} w JOIN {tag}g{h} g ON g.tree = w.tree AND g.run = place // {fanout})""")
        last = f"w_{tag}{levels}"
    return ",\n".join(parts) + f"""
    SELECT doc_id, leaf, x.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, got AS folded_root,
           got = t.digest AS verified
    FROM {last} w JOIN {sub} x ON x.tree = w.src, {top} t"""


def periodic_runs() -> str:
    """op13: every pair of equal words at a distance of at most a quarter of
    the text, islands of consecutive pairs of one distance."""
    return f"""WITH {CRC_TABLE},
    d AS (SELECT doc_id, coalesce({WORDS}, []) AS w, {crc32("doc_id::VARCHAR")} AS h FROM documents, crc_table),
    e AS (SELECT doc_id, w, len(w)::BIGINT AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g FROM d),
    f AS (SELECT *, CASE WHEN hit THEN g % n ELSE n END AS a FROM e),
    p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS per FROM f),
    words AS (SELECT doc_id, n, i, CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % per + 1] END AS word
              FROM (SELECT doc_id, n, a, per, w, unnest(range(n)) AS i FROM p)),
    pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y
              ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    isl AS (SELECT doc_id, i, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM pairs),
    stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isl GROUP BY doc_id, q, grp
                HAVING count(*) + q >= greatest(6, 4 * q)),
    runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY ALL),
    listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), ''
               ORDER BY start, period) AS txt FROM runs GROUP BY doc_id),
    best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
    left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt FROM words ANTI JOIN gone USING (doc_id, i)
                  GROUP BY doc_id)
    SELECT e.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
           period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
           sha256(coalesce(listed.txt, '')) AS runs_sha256, sha256(coalesce(left_over.txt, '')) AS collapsed_sha256
    FROM e LEFT JOIN listed ON listed.doc_id = e.doc_id LEFT JOIN best ON best.doc_id = e.doc_id
    LEFT JOIN left_over ON left_over.doc_id = e.doc_id"""


def queries() -> dict[str, str]:
    return {"op11_virtual_slots": virtual_slots(), "op12_merkle_manifest": merkle(), "op13_periodic_runs": periodic_runs()}
