"""DuckDB SQL for the queries that SQL can express. Rows are told apart by a row number, so repeated ids do no harm."""

from __future__ import annotations

from tesserae.llm import mixing, quality, secrets

WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def quality_rules() -> str:
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER () rid FROM documents),
 ws AS (SELECT rid, regexp_extract_all(t, '{WORD}') ws FROM d),
 w AS (SELECT rid, unnest(ws) w, unnest(range(1, len(ws) + 1)) i FROM ws),
 tri AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o g FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
 rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) c FROM tri WHERE g IS NOT NULL),
 cov AS (SELECT rid, count(DISTINCT i + k) n FROM rep, range(0, 3) r(k) WHERE c > 1 GROUP BY rid),
 li AS (SELECT rid, unnest(string_split(t, chr(10))) l FROM d),
 dup AS (SELECT rid, count(*) n, count(*) - count(DISTINCT l) dups FROM li WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
 m AS (SELECT doc_id, len(ws) n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(t) - length(translate(t, '{quality.SYMBOLS}', '')) n_symbols,
  coalesce(dup.n, 0) n_lines, coalesce(dups, 0) n_dup_lines, coalesce(cov.n, 0) n_repeat_words, length(t) - length(translate(t, '{UPPER}', '')) n_upper
  FROM d JOIN ws USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid)),
 b AS (SELECT *, CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT) + 4 * CAST(10 * n_symbols > 2 * n_words AS INT) + 8 * CAST(100 * n_dup_lines > 50 * n_lines AS INT)
  + 16 * CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INT) + 32 * CAST(2 * n_upper > word_chars AS INT) bits FROM m)
 SELECT doc_id, CAST(n_words AS BIGINT) n_words, CAST(word_chars AS BIGINT) word_chars, CAST(n_symbols AS BIGINT) n_symbols, CAST(n_dup_lines AS BIGINT) n_dup_lines, CAST(n_repeat_words AS BIGINT) n_repeat_words,
 bits & 3 <> 0 base_failed, bits = 0 kept, CAST(bits AS BIGINT) fail_bits FROM b"""


def secret_scans() -> str:
    def found(kind: int, pattern: str) -> str:
        p = _text(pattern)
        return f"""SELECT rid, {kind} k, m, CAST(e - length(m) AS BIGINT) s, CAST(e AS BIGINT) e FROM (SELECT rid, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i) e FROM
 (SELECT rid, unnest(f) m, unnest(regexp_split_to_array(t, {p})[1:len(f)]) g, unnest(range(0, len(f))) i FROM (SELECT rid, t, regexp_extract_all(t, {p}) f FROM d) WHERE len(f) > 0))"""

    allow = " OR ".join(f"regexp_matches(m, {_text(p)})" for p in secrets.ALLOW)
    size = secrets.WINDOW
    fits = lambda c: " AND ".join(f"regexp_matches(m, {_text(x)})" for x in (c.pattern, *c.needs))
    most = "CASE " + " ".join(f"WHEN {fits(c)} THEN {c.most}" for c in secrets.CLASSES) + " END"
    sums = "[" + ", ".join(str(secrets.summand(c)) for c in range(size + 1)) + "]::BIGINT[]"
    names = "CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') t, row_number() OVER () rid FROM documents),
 a AS ({found(0, secrets.ASSIGN)}), base AS (SELECT rid, k, s, e FROM a WHERE length(regexp_extract(m, {_text(secrets.ASSIGN)}, 2)) >= 6
  UNION ALL SELECT rid, k, s, e FROM ({found(1, secrets.ACCESS)}) UNION ALL SELECT rid, k, s, e FROM ({found(2, secrets.HEX)})),
 c AS (SELECT *, {most} most FROM ({found(3, secrets.CANDIDATE)}) WHERE NOT ({allow})),
 p AS (SELECT rid, s, e, most, m, unnest(range(1, length(m) - {size} + 2)) p FROM c WHERE most IS NOT NULL),
 ch AS (SELECT rid, s, e, most, p, unnest(string_split(substr(m, p, {size}), '')) x FROM p),
 n AS (SELECT rid, s, e, most, p, x, count(*) n FROM ch GROUP BY ALL), h AS (SELECT rid, s, e, most, p, sum(({sums})[n + 1]) h FROM n GROUP BY ALL),
 more AS (SELECT DISTINCT rid, 3 k, s, e FROM h WHERE h <= most),
 b1 AS (SELECT rid, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k) x, count(*) FILTER (k = 0) n0, count(*) FILTER (k = 1) n1, count(*) FILTER (k = 2) n2 FROM base GROUP BY rid),
 s1 AS (SELECT rid, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, k) x FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY rid)
 SELECT doc_id, coalesce(n0, 0) n_assign, coalesce(n1, 0) n_access, coalesce(n2, 0) n_hex, sha256(coalesce(b1.x, '')) base_sha256, coalesce(s1.x, '') spans FROM d LEFT JOIN b1 USING (rid) LEFT JOIN s1 USING (rid)"""


def exact_topk(k: int = 20, every: int = 20) -> str:
    return f"""WITH v AS (SELECT vec_id, row_number() OVER () rid, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT a.rid, a.vec_id query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) score FROM v a JOIN v b ON a.vec_id % {every} = 0 AND a.rid <> b.rid),
 r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) "rank" FROM s)
 SELECT query_id, CAST("rank" AS INT) "rank", vec_id, score FROM r WHERE "rank" <= {k}"""


def source_mix(seed: int = 7) -> str:
    weights = ", ".join(f"{w}::DOUBLE" for w in mixing.WEIGHTS)
    return rf"""WITH d0 AS (SELECT doc_id, source, text, coalesce(text, '') t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls,
  coalesce(len(regexp_extract_all(text, '{WORD}')), 0) size, ('0x' || substr(md5(concat_ws('|', '{seed}', doc_id, text)), 1, 13))::BIGINT h FROM documents),
 m AS (SELECT *, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars, length(t) - length(translate(t, '{quality.SYMBOLS}', '')) n_symbols, len(ls) - len(list_distinct(ls)) dups, length(t) - length(translate(t, '{UPPER}', '')) n_upper FROM d0),
 d AS (SELECT doc_id, source, size, h, greatest(0.05::DOUBLE, coalesce(CASE WHEN length(text) > 0 THEN 1.0::DOUBLE - (length(text) - length(translate(text, '{mixing.ODD}', '')))::DOUBLE / length(text) END, 0.05::DOUBLE))
  / pow(2.0::DOUBLE, CAST(size < 50 AS INT) + CAST(10 * n_symbols > 2 * size AS INT) + CAST(100 * dups > 50 * len(ls) AS INT) + CAST(word_chars < 2 * size OR word_chars > 15 * size AS INT) + CAST(2 * n_upper > word_chars AS INT)) w FROM m),
 k AS (SELECT *, -ln((h + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w key FROM d),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) z, ([{weights}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] w FROM d GROUP BY source),
 o AS (SELECT *, z * 3.0::DOUBLE cap, sum(z) OVER () total FROM s),
 p AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) held, sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) free FROM o),
 l AS (SELECT arg_min((total - held) / free, held) FILTER ((total - held) / free < cap / w) lam FROM p WHERE z > 0),
 t AS (SELECT source, z, least(cap, lam * w) target FROM p, l), e AS (SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END epochs FROM t),
 x AS (SELECT k.*, z, target, epochs, target - epochs * z rest, sum(size) OVER (PARTITION BY k.source ORDER BY key, h, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE mid FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
 SELECT doc_id, CAST(size AS BIGINT) size, z source_size, target, CAST(size * (epochs + CASE WHEN mid <= rest AND rest > 0 AND size > 0 THEN 1 ELSE 0 END) AS BIGINT) taken FROM x"""


def all_sql() -> dict[str, str]:
    return {
        "op5_secret_scans": secret_scans(),
        "op7_exact_topk": exact_topk(),
        "op8_quality_rules": quality_rules(),
        "op9_source_mix": source_mix(),
    }
