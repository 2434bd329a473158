"""The queries of this subpackage. SQL expresses three of them; the others have a part (trees, hashes, byte merges, raking, eigenvectors, automata) that it lacks."""

from __future__ import annotations

from functools import wraps

from ..model import ship
from .bpe_count import op4_token_counts
from .decontaminate import op5_benchmark_decontamination
from .langid import op13_language_id
from .media import op7_media_columns
from .merkle import op11_merkle_manifest
from .mixing import op8_source_mixing
from .ppm import op3_lm_scoring
from .quality import op6_quality_classifier
from .simhash import op10_simhash_near_dedup
from .substring_dedup import op2_substring_dedup
from .toxicity import op9_toxicity
from .url_filter import op1_url_filters
from .whitening import op12_embedding_whitening

QUERIES = {
    f.__name__: wraps(f)(lambda spark, sf_dir, f=f: f(ship(spark), sf_dir))
    for f in (
        op1_url_filters,
        op2_substring_dedup,
        op3_lm_scoring,
        op4_token_counts,
        op5_benchmark_decontamination,
        op6_quality_classifier,
        op7_media_columns,
        op8_source_mixing,
        op9_toxicity,
        op10_simhash_near_dedup,
        op11_merkle_manifest,
        op12_embedding_whitening,
        op13_language_id,
    )
}
OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 19] AS win FROM d, unnest(range(1, len(w) - 18)) t(i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, p FROM ranked, unnest(range(i, i + 20)) t(p) WHERE r > 1),
each AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark)),
items AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS win FROM b, unnest(range(1, len(w) - n + 2)) t(i) WHERE n > 0),
wins AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM d, (SELECT DISTINCT n FROM items) s, unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM wins JOIN items USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEAF = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END" for c in FIELDS)
LEVEL = "SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY g, lvl, pos // 2, n"
FOLD = """SELECT f.r, f.g, f.lvl + 1, f.pos // 2, CASE WHEN s.node IS NULL THEN sha256(f.cur) WHEN f.pos % 2 = 1 THEN sha256(s.node || f.cur) ELSE sha256(f.cur || s.node) END, f.proof || coalesce(s.node, '')
FROM {f} f JOIN {t}_depth d ON d.g = f.g AND f.lvl < d.depth LEFT JOIN {t} s ON s.g = f.g AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1)"""
OP11 = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)),
leaves AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, sha256({LEAF}) AS leaf, sha256({LEAF.replace("n_chars", "n_chars + 1")}) AS changed,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM documents, crc),
placed AS (SELECT *, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS shown, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
low(g, lvl, pos, n, node) AS (SELECT g, 0, pos, n, leaf FROM placed UNION ALL {LEVEL.format(t="low")}),
low_depth AS (SELECT g, max(lvl) AS depth FROM low GROUP BY g),
sub AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
top(g, lvl, pos, n, node) AS (SELECT 1, 0, pos, n, subroot FROM sub UNION ALL {LEVEL.format(t="top")}),
top_depth AS (SELECT g, max(lvl) AS depth FROM top GROUP BY g),
climb(r, g, lvl, pos, cur, proof) AS (SELECT r, g, 0, pos, shown, '' FROM placed UNION ALL {FOLD.format(f="climb", t="low")}),
mid AS (SELECT r, sub.g, sub.pos, subroot, cur, proof FROM climb JOIN low_depth d ON climb.g = d.g AND lvl = depth JOIN sub ON climb.g = sub.g),
rise(r, g, lvl, pos, cur, proof) AS (SELECT r, 1, 0, pos, cur, proof FROM mid UNION ALL {FOLD.format(f="rise", t="top")}),
ends AS (SELECT r, cur, proof FROM rise JOIN top_depth ON lvl = depth),
root AS (SELECT node AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(ends.proof) AS proof_sha256, ends.cur AS folded_root, ends.cur = root AS verified FROM placed JOIN mid USING (r) JOIN ends USING (r), root
"""

ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": OP2, "op5_benchmark_decontamination": OP5, "op11_merkle_manifest": OP11}
