"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from functools import reduce

WORD = r"[^\x20\x09-\x0D]+"

#: Shingle sets, all links by an inverted self-join, and reachability by recursion.
JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS ws FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' ')) END) AS g FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), e AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY 1, 2, x.n, y.n
  HAVING {den} * count(*) >= {num} * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

#: Both replicas whole, with running offsets; the damage is that of ``catalog.replica``.
FIXITY = """
WITH p AS (
  SELECT page_id, page_id AS id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages
), q AS (
  SELECT id, CASE WHEN (page_id * 37) % 64 = 0 THEN left(record, length(record) - 1) || '?' ELSE record END AS record FROM p WHERE (page_id * 37) % 64 <> 1
  UNION ALL SELECT -id - 1, record FROM p WHERE (page_id * 37) % 64 = 2
), a AS (SELECT id, sha256(record) AS d, CAST(strlen(record) AS BIGINT) AS b, CAST(coalesce(sum(strlen(record)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM p
), c AS (SELECT id, sha256(record) AS d, CAST(strlen(record) AS BIGINT) AS b, CAST(coalesce(sum(strlen(record)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM q)
SELECT coalesce(a.id, c.id) AS record_id, CASE WHEN c.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'extra' ELSE 'changed' END AS status,
  a.o AS left_offset, c.o AS right_offset, a.b AS left_bytes, c.b AS right_bytes, a.d AS left_digest, c.d AS right_digest
FROM a FULL JOIN c ON a.id = c.id WHERE a.d IS DISTINCT FROM c.d
"""

#: Every window of 50 words by its text, the smallest document of each, and the words that
#: windows of smaller documents cover.
REPEATS = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents
), x AS MATERIALIZED (SELECT doc_id, i, md5_number(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), m AS (SELECT h, min(doc_id) AS m FROM x GROUP BY 1
), gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM x JOIN m USING (h) WHERE m < doc_id
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w) ANTI JOIN gone USING (doc_id, j) GROUP BY 1
), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Matches and the pieces between them give positions; parts link within 256 code points.
SECRETS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, 'assign' AS kind, 1 AS rank, regexp_extract_all(t, '{assign}') AS f, regexp_extract_all(t, '{assign}', 2) AS v, regexp_split_to_array(t, '{assign}') AS g FROM t
  UNION ALL SELECT doc_id, 'access', 2, regexp_extract_all(t, '{access}'), NULL, regexp_split_to_array(t, '{access}') FROM t
  UNION ALL SELECT doc_id, 'hex', 3, regexp_extract_all(t, '{hex}'), NULL, regexp_split_to_array(t, '{hex}') FROM t
  UNION ALL SELECT doc_id, 'weak', 4, regexp_extract_all(t, '{weak}'), NULL, regexp_split_to_array(t, '{weak}') FROM t
  UNION ALL SELECT doc_id, 'endpoint', 5, regexp_extract_all(t, '{endpoint}'), NULL, regexp_split_to_array(t, '{endpoint}') FROM t
), s AS MATERIALIZED (
  SELECT doc_id, kind, rank, list_sum(list_transform(g[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:n - 1], lambda x: length(x))), 0) AS a, length(f[n]) AS l
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS n FROM m)
  WHERE CASE kind WHEN 'assign' THEN length(v[n]) >= 12 WHEN 'weak' THEN regexp_matches(f[n], '[A-Z]') AND regexp_matches(f[n], '[a-z]') AND regexp_matches(f[n], '[0-9]') ELSE TRUE END
), z AS (SELECT doc_id, kind, rank, CAST(a AS BIGINT) AS a, CAST(a + l AS BIGINT) AS b FROM s
), k AS (
  SELECT * FROM z WHERE rank <= 3
  UNION ALL SELECT * FROM z WHERE kind = 'weak' AND EXISTS (SELECT 1 FROM z y WHERE y.doc_id = z.doc_id AND y.kind IN ('access', 'endpoint') AND y.a < z.b + 256 AND y.b > z.a - 256 AND (y.a >= z.b OR y.b <= z.a))
  UNION ALL SELECT * FROM z WHERE kind = 'endpoint' AND EXISTS (SELECT 1 FROM z y WHERE y.doc_id = z.doc_id AND y.rank <= 3 AND y.a < z.b + 256 AND y.b > z.a - 256 AND (y.a >= z.b OR y.b <= z.a))
), j AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (rank > 3) AS n_linked,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank <= 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM k GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_linked, 0) AS n_linked,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN j USING (doc_id)
"""


#: Shares of every kept term in every group and language, each group beside each other.
DIVERGENCE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (SELECT DISTINCT lang, source FROM d
), o AS MATERIALIZED (SELECT n, lang, source, unnest(w) AS item FROM d
), k AS MATERIALIZED (SELECT lang, item, count(*) AS c FROM o GROUP BY 1, 2 HAVING count(DISTINCT n) >= {least}
), v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(c) AS HUGEINT) AS n FROM k GROUP BY 1
), c AS MATERIALIZED (SELECT o.lang, o.source, o.item, count(*) AS c FROM o SEMI JOIN k USING (lang, item) GROUP BY 1, 2, 3
), t AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM c GROUP BY 1, 2
), p AS MATERIALIZED (
  SELECT lang, source, item, coalesce(c.c, 0) AS c, 1 + (1000000000 * CAST(coalesce(c.c, 0) + 5 AS HUGEINT)) // (coalesce(t.n, 0) + 5 * v.v) AS p, 1 + (1000000000 * CAST(k.c + 5 AS HUGEINT)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, item) LEFT JOIN t USING (lang, source)
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.item = y.item GROUP BY 1, 2, 3) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL SELECT lang, source, 'term', item, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= {top}
"""


def manifest_sql(columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), levels: int = 5, above: int = 2) -> str:
    """Trees level by level, up to 16 ** ``levels`` rows a source and 16 ** ``above`` sources;
    a level of one node is left as it is."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(c if c != "text" else text) for c in columns) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "(SELECT list(CAST(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) ORDER BY i) AS crc FROM range(256) r(i))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    check = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"
    out = [f"d0 AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {check} % 5 = 0 THEN {leaf(low)} END AS forged FROM documents, {crc})"]
    out += ["d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node FROM d0)"]

    def grow(name: str, start: str, levels: int) -> None:
        out.append(f"{name}0 AS MATERIALIZED ({start})")
        for k in range(levels):
            run = "PARTITION BY tree, node // 16 ORDER BY node ROWS BETWEEN"
            out.append(
                f"{name}s{k} AS MATERIALIZED (SELECT tree, node, count(*) OVER (PARTITION BY tree) = 1 AS root, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, digest FROM {name}{k})"
            )
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, node // 16 AS node, CASE WHEN any_value(root) THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY node)) END AS digest FROM {name}s{k} GROUP BY tree, node // 16)")

    grow("a", "SELECT source AS tree, node, leaf AS digest FROM d", levels)
    grow("b", f"SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS node, tree AS name, digest FROM a{levels}", above)
    # from a leaf to the root, one step after the other
    steps = [(f"as{k}", f"m.source IS NOT DISTINCT FROM s.tree AND m.node // {16**k} = s.node") for k in range(levels)]
    steps += [(f"bs{k}", f"b.node // {16**k} = s.node") for k in range(above)]
    before = "(SELECT doc_id, source, node, leaf, '' AS proof, coalesce(forged, leaf) AS now FROM d)"
    for i, (table, on) in enumerate(steps):
        top = "LEFT JOIN b0 b ON b.name IS NOT DISTINCT FROM m.source " if table.startswith("b") else ""
        out.append(f"m{i} AS MATERIALIZED (SELECT m.doc_id, m.source, m.node, m.leaf, m.proof || s.l || s.r AS proof, CASE WHEN s.root THEN m.now ELSE sha256(s.l || m.now || s.r) END AS now FROM {before} m {top}JOIN {table} s ON {on})")
        before = f"m{i}"
    return (
        "WITH " + ",\n".join(out) + f"\nSELECT m.doc_id, m.leaf, a.digest AS subroot, b.digest AS root, sha256(m.proof) AS proof_sha256, m.now AS folded_root, m.now = b.digest AS verified"
        f" FROM {before} m JOIN a{levels} a ON a.tree IS NOT DISTINCT FROM m.source, b{above} b"
    )


# The patterns as the contract and the operator's docstring state them.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "weak": r"[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"(?i)(?:https?|jdbc:[a-z0-9]+|postgres|mysql|redis|amqp|s3)://[^\x00-\x20\x22\x27<>]+",
}

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": JACCARD.format(word=WORD, k=3, num=90, den=100),
    "op3_warc_fixity_audit": FIXITY,
    "op7_secret_scan": reduce(lambda s, kv: s.replace("{" + kv[0] + "}", kv[1]), PATTERNS.items(), SECRETS),
    "op9_substring_dedup": REPEATS.format(word=WORD),
    "op12_merkle_manifest": manifest_sql(),
    "op13_source_divergence": DIVERGENCE.format(least=30, top=50),
}
