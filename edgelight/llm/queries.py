"""The queries of this subpackage and the SQL that says what they must return."""

from __future__ import annotations

import functools

from . import filter_audit, lattice, mixing, near_dup, order_minhash, packing, prefix_trie, secret_ledger, sharding, suffix_array, suffix_tree, tool_calls, toxicity
from .common import bounded_batches


def bounded(query):
    """The query in a session that hands rows to Python in bounded batches."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_tool_call_links": tool_calls.op1_tool_call_links,
    "op2_feistel_shards": sharding.op2_feistel_shards,
    "op3_suffix_array_dedup": suffix_array.op3_suffix_array_dedup,
    "op4_odd_sketch_near_dup": near_dup.op4_odd_sketch_near_dup,
    "op5_suffix_tree_dedup": suffix_tree.op5_suffix_tree_dedup,
    "op6_order_minhash": order_minhash.op6_order_minhash,
    "op7_lattice_near_dup": lattice.op7_lattice_near_dup,
    "op8_toxicity_chain": toxicity.op8_toxicity_chain,
    "op9_ordered_packing": packing.op9_ordered_packing,
    "op10_source_mix": mixing.op10_source_mix,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_blob_ledger": secret_ledger.op12_blob_ledger,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
QUERIES = {name: bounded(query) for name, query in QUERIES.items()}

#: The turns of the chat tables as calls and results, linked: what op1 does, in SQL.
TOOL_CALLS = """
WITH calls AS (
  SELECT conv_id, turn, role, text, conv_id::VARCHAR || '-' || turn::VARCHAR AS call_id,
    CASE WHEN role = 'user' AND lag(turn) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) = turn - 2 THEN 0 ELSE 1 END AS fresh
  FROM conversations WHERE role IN ('user', 'system')
), islands AS (
  SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM calls
), deep AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS depth FROM islands
), answers AS (
  SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
), rows AS (
  SELECT c.conv_id, c.call_id, c.turn, CASE c.role WHEN 'user' THEN 'ask' ELSE 'configure' END AS name, c.depth,
    CASE WHEN a.turn IS NULL THEN 'no_result' ELSE 'ok' END AS status,
    list_filter([
      CASE WHEN c.role = 'user' AND length(c.text) % 11 = 0 THEN 'missing:words' WHEN c.role = 'user' AND c.turn % 7 = 3 THEN 'type:words' END,
      CASE WHEN c.role = 'user' AND c.turn % 5 = 4 THEN 'extra:zeal' END,
      CASE WHEN c.role = 'user' AND c.turn >= 2 AND c.fresh = 1 THEN 'unknown_parent' END], lambda x: x IS NOT NULL) AS errors,
    '{"text":' || to_json(coalesce(c.text, ''))::VARCHAR || CASE WHEN c.role <> 'user' OR length(c.text) % 11 = 0 THEN ''
      WHEN c.turn % 7 = 3 THEN ',"words":"' || len(string_split(c.text, ' '))::VARCHAR || '"' ELSE ',"words":' || len(string_split(c.text, ' '))::VARCHAR END
      || CASE WHEN c.role = 'user' AND c.turn % 5 = 4 THEN ',"zeal":1' ELSE '' END || '}' AS arguments,
    a.text AS content, 0 AS kind
  FROM deep c LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
  UNION ALL
  SELECT a.conv_id, a.conv_id::VARCHAR || '-' || (a.turn - 1)::VARCHAR, a.turn, NULL, NULL, 'orphan_result', [], NULL, a.text, 1
  FROM answers a LEFT JOIN calls c ON c.conv_id = a.conv_id AND c.turn = a.turn - 1 WHERE c.turn IS NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY kind, depth, turn, call_id) - 1 AS seq FROM rows
)
SELECT conv_id, call_id, turn, name, depth::BIGINT AS depth, seq::BIGINT AS seq, status, array_to_string(errors, ',') AS errors,
  '{' || CASE WHEN arguments IS NULL THEN '' ELSE '"arguments":' || arguments || ',' END || '"call_id":' || to_json(call_id)::VARCHAR
  || CASE WHEN len(errors) = 0 THEN '' ELSE ',"errors":' || to_json(errors)::VARCHAR END
  || CASE WHEN name IS NULL THEN '' ELSE ',"name":' || to_json(name)::VARCHAR END
  || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END
  || ',"seq":' || seq::VARCHAR || ',"status":' || to_json(status)::VARCHAR || '}' AS message
FROM placed
"""

#: What op3 does: each byte as two hexadecimal digits, cut into pieces so that a string of 50 bytes is taken from a short text.
SUFFIX_ARRAY = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT doc_id, unnest(range(0, strlen(h) // 2, 512)) AS base, h FROM docs
), cut AS (
  SELECT doc_id, base, substring(h, 2 * base + 1, 2 * (512 + 49)) AS piece, least(512, strlen(h) // 2 - base) AS n FROM pieces
), places AS (
  SELECT doc_id, base, piece, unnest(range(n)) AS i FROM cut
), bytes AS (
  SELECT doc_id, base + i AS pos, substring(piece, 2 * i + 1, 2) AS byte, substring(piece, 2 * i + 1, 100) AS string FROM places
), earlier AS (
  SELECT doc_id, pos, byte, CASE WHEN strlen(string) = 100 AND min(doc_id) OVER (PARTITION BY string) < doc_id THEN 1 ELSE 0 END AS starts FROM bytes
), covered AS (
  SELECT doc_id, pos, byte, max(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM earlier
), edges AS (
  SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS opens FROM covered
), counted AS (
  SELECT doc_id, sum(gone) AS n_removed, sum(opens) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM edges GROUP BY doc_id
)
SELECT d.doc_id, (strlen(d.h) // 2)::BIGINT AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(c.kept, ''))) AS kept_sha256
FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id
"""

#: What op4 does. Equal sets are linked through the smallest of them; the others by counting what they share.
NEAR_DUP = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
), alike AS (
  SELECT *, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS first FROM sets
), shingles AS (
  SELECT doc_id AS first, len(s) AS n, unnest(s) AS shingle FROM alike WHERE doc_id = first
), near AS (
  SELECT a.first AS a, b.first AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.first < b.first AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.first, b.first HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), links AS (
  SELECT a, b FROM near UNION SELECT b, a FROM near
), reach AS (
  SELECT DISTINCT first AS a, first AS b FROM alike UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), components AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component AS component_id, doc_id = component AS kept FROM alike JOIN components ON first = a
"""

#: What op5 does: each window as its words, joined by spaces.
SUFFIX_TREE = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos, len(w) AS n FROM docs
), windows AS (
  SELECT doc_id, word, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS said FROM words
), twice AS (
  SELECT doc_id, word, pos, CASE WHEN pos + 35 <= n AND count(*) FILTER (WHERE pos + 35 <= n) OVER (PARTITION BY said) > 1 THEN 1 ELSE 0 END AS starts FROM windows
), covered AS (
  SELECT doc_id, word, pos, max(starts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM twice
), counted AS (
  SELECT doc_id, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM covered GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(c.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN counted c ON c.doc_id = d.doc_id
"""

#: What op7 does, by comparing all pairs. The lattice index may miss a link (tests/llm measure how many); in the tables of sf0.001 to sf0.1
#: no two vectors are near enough for one, so that there the SQL says that nothing is linked that should not be.
LATTICE = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), sound AS (
  SELECT * FROM vectors WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), degrees AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), components AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component AS component_id, vec_id = component AS kept
FROM vectors JOIN components c ON c.a = vec_id LEFT JOIN degrees d ON d.a = vec_id
"""

#: What op11 does: documents by the filters they fail, then each order of the filters over these.
FILTER_AUDIT = """
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, doc_id, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails FROM docs
), counted AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM judged j LEFT JOIN marks m ON m.doc_id = j.doc_id GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), failing AS (
  SELECT *, coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda x: x <> ''), lambda x: instr(o, x))), 6) AS place FROM counted, orders
), steps AS (
  SELECT part, o AS filter_order, step::INT AS step, substring(o, step, 1) AS filter, sum(CASE WHEN place > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN place = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN place < step AND contains(fails, substring(o, step, 1)) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = substring(o, step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN place = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN place = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM failing, range(1, 6) s(step) GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM steps
"""


def _spans_sql() -> str:
    """For each kind, the pieces of a text between matches and the matches themselves give the places of both."""
    parts = []
    for i, rule in enumerate(r for p in (secret_ledger.BASE, secret_ledger.FORMATS) for r in p.rules):
        pattern = (("(?i)" if rule.folded else "") + rule.pattern).replace("'", "''")
        whole, wanted = (f"regexp_extract_all(t, '{pattern}', {g})" for g in (0, rule.group))
        parts.append(f"SELECT doc_id, t, {i} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, {whole} AS m, {wanted} AS g, regexp_split_to_array(t, '{pattern}') AS b FROM docs")
    return " UNION ALL ".join(parts)


#: What op12 does, without the ledger. A digit i of the list of matches and of the texts before them gives where a match starts.
BLOB_LEDGER = f"""
WITH docs AS (
  SELECT row_number() OVER () AS nth, doc_id AS id, doc_id, coalesce(text, '') AS t FROM documents
), found AS ({_spans_sql().replace("SELECT doc_id,", "SELECT nth,")}
), matched AS (
  SELECT nth, rank, kind, least, unnest(m) AS m, unnest(g) AS g, unnest(b[1:len(m)]) AS before, unnest(range(len(m))) AS i FROM found WHERE len(m) > 0
), placed AS (
  SELECT *, sum(length(before) + length(m)) OVER (PARTITION BY nth, rank ORDER BY i) AS stop FROM matched
), spans AS (
  SELECT nth, rank, kind, stop - length(m) AS start, kind || ':' || (stop - length(m))::VARCHAR || ':' || stop::VARCHAR AS said FROM placed WHERE length(g) >= least
), joined AS (
  SELECT nth, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(said, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY nth
)
SELECT id AS doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN joined j ON j.nth = d.nth
"""

#: What op13 does: each prefix as the list of its turns. crc32 goes bit by bit over the digits of conv_id.
PREFIX_TRIE = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, sha256(text)) AS own FROM turns GROUP BY conv_id
), bits AS (
  SELECT *, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c)::BIGINT >> i) & 1))) AS b FROM convs
), heads AS (
  SELECT conv_id, own, xor(list_reduce([4294967295::BIGINT] || b, lambda s, x: CASE WHEN xor(s, x) & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 4 AS h FROM bits
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:h], c.own[h + 1:]) AS said FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
), prefixes AS (
  SELECT conv_id, unnest(range(len(said) + 1)) AS depth, said FROM rebuilt
), nodes AS (
  SELECT depth, said[1:depth] AS said, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(prefixes.said) = depth), '') AS ends
  FROM prefixes GROUP BY depth, said[1:depth]
), parents AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND n.said[1:n.depth - 1] = p.said
), counted AS (
  SELECT p.*, coalesce(c.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(said[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM parents p LEFT JOIN (SELECT parent_conv_id AS k, depth - 1 AS d, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL) c ON c.k = p.conv_id AND c.d = p.depth
), above AS (
  SELECT unnest(range(depth + 1)) AS depth, said[1:unnest(range(depth + 1))] AS said, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, saved FROM counted
), sums AS (
  SELECT depth, said, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL
)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums s ON s.depth = c.depth AND s.said = c.said
"""

#: The other operators hash, sample, pack, learn or search approximately: tests/llm hold them to brute force, an exact round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op1_tool_call_links": TOOL_CALLS, "op3_suffix_array_dedup": SUFFIX_ARRAY, "op4_odd_sketch_near_dup": NEAR_DUP, "op5_suffix_tree_dedup": SUFFIX_TREE, "op7_lattice_near_dup": LATTICE,
    "op11_filter_audit": FILTER_AUDIT, "op12_blob_ledger": BLOB_LEDGER, "op13_prefix_trie": PREFIX_TRIE}
