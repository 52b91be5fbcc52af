"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .alignment import op12_alignment
from .decontamination import op9_decontamination
from .fingerprints import op1_order_minhash
from .html_extract import op3_html_template
from .mixing import op10_mixing
from .packing import op11_packing
from .resampling import op13_resampling
from .sharding import op7_sharding
from .simhash import op2_simhash
from .substring_dedup import op6_substring_dedup
from .token_codec import op8_token_codec
from .token_count import op4_token_count
from .toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_order_minhash, op2_simhash, op3_html_template, op4_token_count, op5_toxicity, op6_substring_dedup, op7_sharding, op8_token_codec, op9_decontamination, op10_mixing,
                                     op11_packing, op12_alignment, op13_resampling)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op6_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
k AS (SELECT s.r, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM s JOIN d USING (r)),
m AS (SELECT r, p FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
c AS (SELECT r, list_distinct(flatten(list(range(p, p + 35)))) AS hit FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(hit), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN hit IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(hit, i)] END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN c USING (r)""",
    "op9_decontamination": f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
x AS (SELECT r, n, p, w FROM d, (SELECT DISTINCT n FROM iw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p)),
h AS (SELECT r, p, x.n, item FROM x JOIN iw ON iw.n = x.n AND iw.t = array_to_string(w[p:p + x.n - 1], ' ')),
a AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
b AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN a USING (r) LEFT JOIN b USING (r)""",
}
