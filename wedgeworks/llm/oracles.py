"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from wedgeworks.llm import repetition

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op1() -> str:
    grams = repetition.GRAM_LIMITS
    lengths = sorted(grams)
    ahead = "".join(f", lead(w, {j}) OVER o w{j}" for j in range(1, lengths[-1]))
    gram = "".join(f", md5(w || {' || '.join(f"' ' || w{j}" for j in range(1, n))}) g{n}" for n in lengths)
    tally = "".join(f", count(*) OVER (PARTITION BY r, g{n}) c{n}, row_number() OVER (PARTITION BY r, g{n} ORDER BY i) k{n}" for n in lengths)
    cover = "".join(
        f", max(CASE WHEN g{n} IS NOT NULL AND c{n} > 1 AND k{n} > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) later{n}" for n in lengths
    )
    base = repetition.BASE_GRAM
    cover += f", max(CASE WHEN g{base} IS NOT NULL AND c{base} > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {base - 1} PRECEDING AND CURRENT ROW) any_rep"
    sums = "".join(f", CAST(sum(CASE WHEN later{n} = 1 THEN length(w) ELSE 0 END) AS BIGINT) dup_{n}gram_chars" for n in lengths)
    shown = "".join(f", coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in lengths)
    over = " OR ".join([f"dup_line_chars > {repetition.LINE_LIMIT} * word_chars", *(f"dup_{n}gram_chars > {grams[n]} * word_chars" for n in lengths)])
    return rf"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
lists AS (SELECT r, regexp_extract_all(t, '{WORDS}') ws FROM d),
words AS (SELECT r, unnest(ws) w, generate_subscripts(ws, 1) i FROM lists),
next AS (SELECT r, i, w{ahead} FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT r, i, w{gram} FROM next),
tallied AS (SELECT *{tally} FROM grams),
covered AS (SELECT r, w{cover} FROM tallied),
per AS (SELECT r, count(*) n_words, CAST(sum(length(w)) AS BIGINT) word_chars, CAST(sum(any_rep) AS BIGINT) n_repeat_words{sums} FROM covered GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) p FROM d),
ranked AS (SELECT r, l, row_number() OVER (PARTITION BY r, l ORDER BY p) k FROM lines WHERE regexp_matches(l, '{WORDS}')),
again AS (SELECT r, count(*) n_dup_lines, CAST(sum(length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g'))) AS BIGINT) dup_line_chars FROM ranked WHERE k > 1 GROUP BY r),
every AS (SELECT doc_id, coalesce(n_words, 0) n_words, coalesce(word_chars, 0) word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) n_symbols, coalesce(n_dup_lines, 0) n_dup_lines,
    coalesce(n_repeat_words, 0) n_repeat_words, coalesce(dup_line_chars, 0) dup_line_chars{shown}
  FROM d LEFT JOIN per USING (r) LEFT JOIN again USING (r)),
judged AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.BASE_PERCENT} * n_words AS base_failed FROM every)
SELECT *, NOT base_failed AND NOT ({over}) AS kept FROM judged"""


OP8 = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) l, generate_subscripts(ls, 1) p FROM d),
keyed AS (SELECT *, translate(trim(l, {SPACES}), '{UPPER}', '{LOWER}') k FROM lines),
shared AS (SELECT k, max(doc_id) last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> last gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) n_lines, count(*) FILTER (WHERE gone) n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) kept_sha256
FROM judged GROUP BY r, doc_id"""

OP4 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, source IS NULL nul, coalesce(source, '') s,
    CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) size, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) h FROM documents),
sizes AS (SELECT nul, s, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY ALL),
ranked AS (SELECT *, (row_number() OVER (ORDER BY nul, s) - 1) % 3 + 1 weight, 3 * source_size cap FROM sizes),
ratio AS (SELECT *, cap / weight ratio FROM ranked),
filled AS (SELECT *, coalesce(sum(cap) OVER w, 0) caps, coalesce(sum(weight) OVER w, 0) weights, sum(source_size) OVER () total, sum(weight) OVER () alls
  FROM ratio WINDOW w AS (ORDER BY ratio, nul, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(total - caps AS DOUBLE) / CAST(alls - weights AS DOUBLE) lev FROM filled),
cut AS (SELECT arg_min(lev, (ratio, nul, s)) FILTER (WHERE ratio >= lev) lvl FROM levels),
sources AS (SELECT nul, s, source_size, CASE WHEN lvl IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * lvl) END target,
    CAST(greatest(1, (total + 65535) // 65536) AS BIGINT) block, CAST(total AS BIGINT) total FROM levels, cut),
sb AS MATERIALIZED (SELECT *, (source_size + block - 1) // block blocks, (total + block - 1) // block seats FROM sources),
quot AS (SELECT nul, s, blocks, seats, target, unnest(range(1, least(3 * blocks, CAST(floor(target / block) AS BIGINT) + (SELECT count(*) FROM sb) + 1) + 1)) k FROM sb WHERE target > 0),
won AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, nul, s, k) seat FROM quot) WHERE seat <= seats),
b AS (SELECT nul, s, blocks, unnest(range(0, blocks)) block_id FROM sb),
bo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY nul, s ORDER BY md5(concat_ws(':', 'mix-1', CAST(nul AS VARCHAR), s, CAST(block_id AS VARCHAR))), block_id) - 1 rk FROM b),
reps AS (SELECT bo.nul, bo.s, bo.block_id, count(k) reps FROM bo LEFT JOIN won ON bo.nul = won.nul AND bo.s = won.s AND (won.k - 1) % won.blocks = bo.rk GROUP BY ALL),
pre AS MATERIALIZED (SELECT *, coalesce(sum(reps) OVER (PARTITION BY nul, s ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) before FROM reps),
st AS MATERIALIZED (SELECT *, CAST(sum(size) OVER (PARTITION BY nul, s ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) fin FROM d),
x AS (SELECT st.*, source_size, target, block, fin - size ini FROM st JOIN sb ON st.nul = sb.nul AND st.s = sb.s)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE
    (p1.before * block + p1.reps * (fin - p1.block_id * block)) - (p0.before * block + p0.reps * (ini - p0.block_id * block)) END AS BIGINT) taken
FROM x LEFT JOIN pre p0 ON p0.nul = x.nul AND p0.s = x.s AND p0.block_id = ini // block
LEFT JOIN pre p1 ON p1.nul = x.nul AND p1.s = x.s AND p1.block_id = greatest(fin - 1, 0) // block"""

ORACLES: dict[str, str] = {"op1_repetition": _op1(), "op4_mix": OP4, "op8_line_dedup": OP8}
