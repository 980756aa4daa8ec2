"""SQL for DuckDB that gives the rows of the catalogue's queries: one chain of common table expressions, many endings."""

from __future__ import annotations

from .config import Config
from .functions import text as T
from .sources.records import CAND_SQL, S1_SQL, TABLES

B, N, SPLIT = Config().blocking, Config().normalise, Config().split
#: Latin letters and the Greek ones that stand for them in the records of er_translit.
GREEK = ("abcdefghijklmnopqrstuvwxyz", "αβψδεφγηιξκλμνοπθρστυωςχυζ")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _chain(rarity: str = "[1:6]") -> list[tuple[str, str]]:
    """``rarity``: the part of the token lists that the columns of rarity are made of; only er_rarity reads them, whole."""
    alias = T.ALIAS
    noise = r"\([ \t]*id:?[ \t]*[0-9]+[ \t]*\)|[ \t]*\|.*$|\bm/s\b"
    url = r"\.(?:com|in|net|org|fr|co|io)\b|^[@#]|www\."
    parts = r"www\.|\.(?:com|in|net|org|fr|co|io)\b|^[@#]"
    place = r"\bp\.?[ \t]?o\.?[ \t]*box[ \t]*[0-9]+|\bnull\b|\bn/a\b"
    surface = {w: short for short, forms in T.SHORT_FORMS.items() for w in forms.split()}
    surface_map = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in surface.items()) + "}"
    squeeze = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
    words = lambda x, sep="' '": f"list_filter(list_transform(string_split({x}, {sep}), lambda t: trim(t)), lambda t: t <> '')"
    cross = lambda a, b, f: f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: concat_ws('|', '{f}', x, y))))"
    pairs = lambda a, f: f"list_filter(flatten(list_transform({a}, lambda x: list_transform({a}, lambda y: CASE WHEN x < y THEN concat_ws('|', '{f}', x, y) END))), lambda k: k IS NOT NULL)"
    gone = lambda s, w: f"(CASE WHEN {s} >= 10 THEN list_transform(range(1, least({w}, length(CAST({s} AS VARCHAR))) + 1), lambda i: CAST(concat(left(CAST({s} AS VARCHAR), i - 1), substr(CAST({s} AS VARCHAR), i + 1)) AS INT)) ELSE [] END)"
    num_ok = "len(a.nums) > 0 AND len(b.nums) > 0"
    inside = "list_contains(b.nums, a.nums[1])"
    dig = "length(CAST(x AS VARCHAR))"
    p = "CAST(a.nums[1] AS VARCHAR)"
    both = lambda c: f"CASE WHEN {num_ok} THEN CAST({c} AS DOUBLE) END"
    idf_sum = lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: t.idf)), 0)"
    common = lambda x, y: f"list_filter({x}, lambda t: list_contains(list_transform({y}, lambda u: u.token), t.token))"
    share = lambda x, y: f"CASE WHEN {idf_sum(x)} > 0 THEN round({idf_sum(common(x, y))} / {idf_sum(x)}, 9) END"

    def rare(x, y):
        return f"round(coalesce(list_max(list_transform({common(x, y)}, lambda t: t.idf)), 0.0), 9)"

    chain = [
        ("s1_business", S1_SQL.format(**{t: t for t in TABLES})), ("cand_business", CAND_SQL),
        ("raw", "SELECT entity_id, business_name, business_address, country, 1 AS src FROM s1_business UNION ALL SELECT entity_id, business_name, business_address, country, 2 FROM cand_business"),
        ("n1", f"SELECT *, regexp_matches(business_name, '{alias}') AS f_alias, lower(CASE WHEN regexp_matches(business_name, '{alias}') THEN regexp_extract(business_name, '{alias}', 2) ELSE business_name END) AS nm, regexp_replace(lower(business_address), '{place}', ' ', 'g') AS ad FROM raw"),
        ("n2", f"SELECT *, regexp_replace(nm, '{noise}', ' ', 'g') AS n FROM n1"),
        ("n3", f"SELECT *, regexp_matches(n, '{T.JUNK}') AS f_junk, regexp_replace(n, '{T.JUNK}', '') AS m FROM n2"),
        ("n4", f"SELECT *, regexp_matches(m, '{url}') AS f_url, regexp_replace(m, '{parts}', ' ', 'g') AS u FROM n3"),
    ]
    clean = f"regexp_replace(replace(regexp_replace(u, '\\b([a-z0-9_])\\.', '\\1', 'g'), '&', ' and '), '{T.SYMBOLS}', ' ', 'g')"
    joined = "array_to_string(addr_comps, ' ')"
    comp = f"regexp_replace(x, '{T.SYMBOLS}', ' ', 'g')"
    chain += [
        ("n5", f"SELECT *, {squeeze(clean)} AS name FROM n4"),
        ("base", f"""SELECT src, entity_id, country, f_alias, f_url, f_junk, {words('name')} AS name_tokens,
  list_filter(list_transform({words('ad', "','")}, lambda x: {squeeze(comp)}), lambda x: x <> '') AS addr_comps,
  list_transform(regexp_extract_all(ad, '([0-9]+)', 1), lambda x: CAST(right(regexp_replace(x, '^0+([0-9])', '\\1'), 9) AS INT)) AS all_nums FROM n5"""),
        ("f1", f"""SELECT *, all_nums[1:6] AS nums, len(all_nums) AS n_nums, len(addr_comps) = 0 AS f_empty_addr,
  list_transform(name_tokens, lambda x: CASE WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '\\p{{L}}') THEN translate(x, '{T.HOMOGLYPHS[0]}', '{T.HOMOGLYPHS[1]}') ELSE x END) AS toks FROM base"""),
        ("f2", f"SELECT *, list_filter(toks, lambda x: NOT list_contains({_list(T.LEGAL)}, x)) AS c0, list_filter(list_transform({words(joined)}, lambda x: coalesce({surface_map}[x], x)), lambda x: NOT list_contains({_list(T.ADDR_STOP)}, x)) AS addr FROM f1"),
        ("final", """SELECT src, entity_id, country, f_alias, f_url, f_junk, f_empty_addr, nums, n_nums, toks, addr, CASE WHEN len(c0) > 0 THEN c0 ELSE toks END AS core,
  list_filter(addr, lambda x: NOT regexp_matches(x, '[0-9]')) AS addr_tokens FROM f2"""),
        ("fin", """SELECT *, array_to_string(core, ' ') AS name_core, array_to_string(core, '') AS name_nospace, coalesce(len(core) = 1 AND NOT f_url AND length(core[1]) >= 5 AND regexp_matches(core[1], '^[a-z]+$'), false) AS f_pseudo FROM final"""),
        ("klists", f"""SELECT country, entity_id, src, core[1:{B.name_tokens}] AS nt, addr_tokens[1:{B.addr_tokens}] AS adt, nums[1:{B.number_keys}] AS nn, nums[1] AS num0, name_nospace FROM fin"""),
        ("keys", f"""SELECT DISTINCT country, unnest(list_concat({cross('nt', 'nn', 'nu')}, {cross('adt', 'nn', 'au')}, {pairs('nt', 'nn')}, {cross(f'nt[1:{B.pair_tokens}]', 'adt', 'na')},
  CASE WHEN name_nospace <> '' THEN [concat('ns|', name_nospace)] ELSE [] END, list_transform(nt, lambda x: concat('n1|', x)), {pairs('adt', 'aa')},
  CASE WHEN src = 1 AND num0 IS NOT NULL THEN {cross(f'adt[1:{B.pair_tokens}]', gone('num0', 6), 'au')} ELSE [] END)) AS key, entity_id, src FROM klists"""),
        ("postings", f"SELECT country, key, count(*) AS n FROM keys WHERE src = 1 GROUP BY country, key HAVING count(*) <= {B.key_cap}"),
        ("votes", """SELECT c.entity_id AS c_id, s.entity_id AS s1_id, c.country, round(sum(1.0 / log2(1.0 + n)), 9) AS votes FROM keys c JOIN keys s ON c.country = s.country AND c.key = s.key AND c.src = 2 AND s.src = 1
  JOIN postings q ON q.country = c.country AND q.key = c.key GROUP BY ALL"""),
        ("ranked", "SELECT *, row_number() OVER (PARTITION BY c_id ORDER BY votes DESC, s1_id) - 1 AS rank, max(votes) OVER (PARTITION BY c_id) AS best FROM votes"),
        ("pairs", f"SELECT c_id, s1_id, country, votes, rank, votes / best AS rel FROM ranked WHERE rank < {B.top} AND votes >= {B.min_rel_votes} * best"),
        ("truth", "SELECT origin_id AS s1_id, entity_id AS c_id FROM cand_business WHERE NOT is_decoy"),
    ]
    for col, name in (("core", "nm"), ("addr_tokens", "ad")):
        chain += [
            (f"{name}_tab", f"SELECT token, ln((SELECT count(*) FROM s1_business) / count(*)) AS idf FROM (SELECT unnest({col}) AS token FROM fin WHERE src = 1) GROUP BY token"),
            (f"{name}_list", f"""SELECT entity_id, list({{'token': t.token, 'idf': coalesce(i.idf, (SELECT max(idf) FROM {name}_tab))}} ORDER BY pos) AS l FROM (SELECT entity_id, unnest({col}{rarity}) AS token, unnest(range(len({col}{rarity}))) AS pos FROM fin) t LEFT JOIN {name}_tab i ON i.token = t.token GROUP BY entity_id"""),
        ]
    chain += [
        ("ncount", "SELECT country, name_core, count(*) AS name_n FROM fin WHERE src = 1 GROUP BY ALL"),
        ("sided", "SELECT f.*, name_n, coalesce(n.l, []) AS nml, coalesce(d.l, []) AS adl FROM fin f LEFT JOIN ncount c USING (country, name_core) LEFT JOIN nm_list n ON n.entity_id = f.entity_id LEFT JOIN ad_list d ON d.entity_id = f.entity_id"),
        ("feats", f"""SELECT q.*, {both(inside)} AS num_p_in, {both('b.nums[1] = a.nums[1]')} AS num_p_first,
  {both('len(list_filter(a.nums, lambda x: list_contains(b.nums, x))) / len(a.nums)')} AS num_frac1, {both('len(list_filter(b.nums, lambda x: list_contains(a.nums, x))) / len(b.nums)')} AS num_frac2,
  {both('round(ln(1 + least(list_min(list_transform(b.nums, lambda x: abs(x - a.nums[1]))), 1000000000)), 9)')} AS num_logdiff,
  {both(f'a.nums[1] >= 10 AND NOT {inside} AND len(list_filter(b.nums, lambda x: {dig} < length({p}) AND (right({p}, {dig}) = CAST(x AS VARCHAR) OR left({p}, {dig}) = CAST(x AS VARCHAR)))) > 0')} AS num_drop,
  {both(f'NOT {inside} AND list_has_any(b.nums, {gone("a.nums[1]", 9)})')} AS num_del_any,
  CASE WHEN len(list_filter(a.nums, lambda x: x >= 10000)) > 0 AND len(list_filter(b.nums, lambda x: x >= 10000)) > 0 THEN CAST(list_has_any(list_filter(a.nums, lambda x: x >= 10000), list_filter(b.nums, lambda x: x >= 10000)) AS DOUBLE) END AS num_long,
  len(a.nums) AS n_nums1, len(b.nums) AS n_nums2,
  {share('a.nml', 'b.nml')} AS nm_idf_cov1, {share('b.nml', 'a.nml')} AS nm_idf_cov2, {rare('a.nml', 'b.nml')} AS nm_idf_rare, {share('a.adl', 'b.adl')} AS ad_idf_cov1, {share('b.adl', 'a.adl')} AS ad_idf_cov2, {rare('a.adl', 'b.adl')} AS ad_idf_rare,
  CAST(b.f_alias AS INT) AS c_f_alias, CAST(b.f_url AS INT) AS c_f_url, CAST(b.f_junk AS INT) AS c_f_junk, CAST(b.f_empty_addr AS INT) AS c_f_empty_addr, CAST(b.f_pseudo AS INT) AS c_f_pseudo,
  len(b.core) - len(a.core) AS tok_diff, len(a.core) AS n_tok1, CAST(starts_with(q.c_id, 'S3') AS INT) AS c_s3, CAST(a.name_core = b.name_core AS INT) AS nm_exact, round(ln(1 + coalesce(a.name_n, 0)), 9) AS s1_name_n, round(ln(1 + coalesce(b.name_n, 0)), 9) AS c_name_n,
  a.name_core AS a_core, b.name_core AS b_core FROM pairs q JOIN sided a ON a.entity_id = q.s1_id JOIN sided b ON b.entity_id = q.c_id"""),
        ("scored", """SELECT f.s1_id, f.c_id, country, rank, round(least(0.45 * rel + 0.35 * coalesce(num_p_in, 0.3) + 0.2 * nm_exact, 0.99), 9) AS p, CASE WHEN nm_exact = 1 AND num_p_in = 0 THEN 1 ELSE 0 END AS sib, CASE WHEN t.c_id IS NULL THEN 0 ELSE 1 END AS y
  FROM feats f LEFT JOIN truth t ON t.s1_id = f.s1_id AND t.c_id = f.c_id"""),
        ("owned", "SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY c_id ORDER BY p DESC, rank, s1_id) = 1"),
        ("pre", """SELECT *, row_number() OVER w AS k, sum(p) OVER w AS top, sum(p) OVER (PARTITION BY s1_id) AS total, exp(sum(ln(1 - least(p, 1 - 1e-7))) OVER (PARTITION BY s1_id)) AS none
  FROM owned WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, c_id ROWS UNBOUNDED PRECEDING)"""),
        ("ef", "SELECT *, round(1.25 * top / (k + 0.25 * total), 12) AS ef FROM pre"),
        ("ef2", "SELECT *, first_value(k) OVER v AS kbest, max(ef) OVER (PARTITION BY s1_id) AS efbest FROM ef WINDOW v AS (PARTITION BY s1_id ORDER BY ef DESC, k)"),
        ("chosen", "SELECT s1_id, c_id, p FROM ef2 WHERE efbest > none AND k <= kbest"),
        ("single", "SELECT s1_id, min(CAST(starts_with(c_id, 'S3') AS INT)) AS has FROM chosen GROUP BY s1_id HAVING min(CAST(starts_with(c_id, 'S3') AS INT)) = max(CAST(starts_with(c_id, 'S3') AS INT))"),
        ("free", "SELECT d.s1_id, d.c_id, d.p FROM scored d JOIN single USING (s1_id) WHERE d.p >= 0.5 AND d.c_id NOT IN (SELECT c_id FROM chosen) AND CAST(starts_with(d.c_id, 'S3') AS INT) <> has"),
        ("free1", "SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY c_id ORDER BY p DESC, s1_id) = 1"),
        ("added", "SELECT * FROM free1 QUALIFY row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, c_id) = 1"),
        ("sel", "SELECT s1_id, c_id, p FROM chosen UNION SELECT s1_id, c_id, p FROM added"),
        ("decided", "SELECT d.*, s.c_id IS NOT NULL AS selected FROM scored d LEFT JOIN sel s ON s.s1_id = d.s1_id AND s.c_id = d.c_id"),
    ]
    return chain


def _entities(name: str, predicted: str) -> list[tuple[str, str]]:
    return [(f"{name}_counts", f"""SELECT s.entity_id AS s1_id, (SELECT count(*) FROM {predicted} x JOIN truth t USING (s1_id, c_id) WHERE x.s1_id = s.entity_id) AS tp, (SELECT count(*) FROM {predicted} x WHERE x.s1_id = s.entity_id) AS n_pred,
  (SELECT count(*) FROM truth t WHERE t.s1_id = s.entity_id) AS n_gt, s.country FROM s1_business s"""),
            (name, f"""SELECT s1_id, country, tp, n_pred, n_gt, round(CASE WHEN n_pred = 0 AND n_gt = 0 THEN 1.0 ELSE 1.25 * tp / (n_pred + 0.25 * n_gt) END, 9) AS f, round(CASE WHEN n_pred > 0 THEN tp / n_pred WHEN n_gt = 0 THEN 1.0 END, 9) AS precision,
  CASE WHEN n_gt > 0 THEN round(tp / n_gt, 9) END AS recall FROM {name}_counts""")]


SUMMARY = "count(*) AS entities, round(avg(f), 9) AS f, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(CASE WHEN n_gt = 0 THEN CAST(n_pred > 0 AS INT) END), 9) AS singleton_fp, round(avg(CAST(n_pred > 0 AS INT)), 9) AS coverage, sum(tp) AS tp, sum(n_pred) AS n_pred, sum(n_gt) AS n_gt"
SCORES = "round({0} / nullif({0} + {1}, 0), 9) AS precision, round({0} / nullif({0} + {2}, 0), 9) AS recall, round(2 * {0} / nullif(2 * {0} + {1} + {2}, 0), 9) AS f1, round(1.25 * {0} / nullif(1.25 * {0} + {1} + 0.25 * {2}, 0), 9) AS f05"


def _endings() -> dict[str, str]:
    u = lambda c, salt="": f"(CAST(concat('0x', substr(md5(concat({c}, '{salt}')), 1, 8)) AS BIGINT) % 10000) / 10000"
    auc = lambda t: f"""(SELECT round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 9) FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {t} GROUP BY p))) AS auc,
  (SELECT round(sum(pos * tp / total) / nullif(sum(pos), 0), 9) FROM (SELECT *, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS total FROM (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM {t} GROUP BY p) WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))) AS ap"""  # noqa: E731
    cuts = [(f"rank<{k}", f"rank < {k}") for k in (1, 2, 3, 4, 6, 8)] + [(f"rel>={r}", f"rel >= {r}") for r in (0.2, 0.35, 0.5)]
    margin = lambda w: f"p - CASE WHEN count(*) OVER {w} = 1 THEN 0 WHEN p >= max(p) OVER {w} THEN nth_value(p, 2) OVER ({w} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE max(p) OVER {w} END"
    floors = "(SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS floor)"
    dens = lambda t: f"(SELECT s.country, round(coalesce(n, 0) / e, 9) AS per_entity FROM (SELECT country, count(*) AS e FROM s1_business GROUP BY country) s LEFT JOIN (SELECT country, count(*) AS n FROM {t} GROUP BY country) c USING (country))"
    accents = [(a, b) for a, b in zip(*T._latin(), strict=False)]
    folded = f"translate(lower(coalesce(text, '')), '{''.join(a for a, _ in accents)}', '{''.join(b for _, b in accents)}')"
    verdict = "CASE WHEN d.c_id IS NULL THEN 'no candidate' WHEN selected THEN 'matched' WHEN o.s1_id <> d.s1_id THEN 'claimed by another entity' ELSE 'rejected' END"
    once = lambda c: f"list_filter(list_transform(regexp_extract_all({c}, '([0-9]+)', 1), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')), lambda x: true)"
    comps = "SELECT *, row_number() OVER (PARTITION BY comp2 ORDER BY n * n / (f1 * f2) DESC, comp1) AS k FROM comp_pairs WHERE comp1 <> comp2 AND NOT regexp_matches(comp2, '[0-9]') QUALIFY k = 1"
    places = "(SELECT b.entity_id, coalesce(list(DISTINCT k.comp) FILTER (p.comp IS NOT NULL), []) AS l FROM base b LEFT JOIN kc k ON k.entity_id = b.entity_id LEFT JOIN places p ON p.comp = k.comp GROUP BY b.entity_id)"
    surface = "MAP {" + ", ".join(f"'{w}': '{short}'" for short, forms in T.SHORT_FORMS.items() for w in forms.split()) + "}"
    return {
        "er_source1": "SELECT entity_id, business_name, business_address, country FROM s1_business",
        "er_candidates": "SELECT * FROM cand_business",
        "er_norm": "SELECT entity_id, country, array_to_string(name_tokens, ' ') AS name, array_to_string(addr_comps, '|') AS comps, f_alias, f_url, f_junk, len(addr_comps) = 0 AS f_empty_addr FROM base",
        "er_house_numbers": "SELECT entity_id, array_to_string(all_nums[1:6], ',') AS nums, CAST(len(all_nums) AS INT) AS n_nums FROM base",
        "er_final": "SELECT entity_id, array_to_string(toks, ' ') AS name_full, name_core, name_nospace, CAST(len(core) AS INT) AS n_name_tok, array_to_string(addr, ' ') AS addr_norm, array_to_string(addr_tokens, ' ') AS addr_alpha, f_pseudo FROM fin",
        "er_digit_deletions": "SELECT * FROM (SELECT entity_id, array_to_string(list_transform(range(1, least(6, length(CAST(nums[1] AS VARCHAR))) + 1), lambda i: CAST(concat(left(CAST(nums[1] AS VARCHAR), i - 1), substr(CAST(nums[1] AS VARCHAR), i + 1)) AS INT)), ',') AS gone FROM fin WHERE src = 1 AND nums[1] >= 10) WHERE gone <> ''",
        "er_fold_documents": f"SELECT doc_id, md5({folded}) AS folded FROM documents",
        "er_url_hosts": r"SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#:]+)', 1) AS host, regexp_matches(regexp_extract(lower(url), '^https?://([^/?#:]+)', 1), '\.(?:com|in|net|org|fr|co|io)\b|^[@#]|www\.') AS f_url FROM pages",
        "er_vocabulary": "SELECT DISTINCT unnest(name_tokens) AS token FROM base",
        "er_component_pairs": "SELECT comp2, comp1, n, f1, f2 FROM comp_pairs",
        "er_localities": "SELECT comp, n, round(n / total, 9) AS share FROM places",
        "er_pseudo_pairs": f"""SELECT DISTINCT s1_id, c_id FROM (SELECT country, name, num, min(entity_id) AS s1_id FROM bc WHERE src = 1 AND num IS NOT NULL GROUP BY ALL HAVING count(*) = 1) JOIN (SELECT entity_id AS c_id, country, name, unnest(n3) AS num FROM bc WHERE src = 2) USING (country, name, num)""",
        "er_block_keys": "SELECT country, key, entity_id FROM keys", "er_postings": "SELECT country, key, n FROM postings", "er_votes": "SELECT c_id, s1_id, country, votes FROM votes",
        "er_top_candidates": "SELECT c_id, s1_id, country, votes, CAST(rank AS INT) AS rank, round(rel, 9) AS rel FROM pairs",
        "er_recall_curve": " UNION ALL ".join(f"SELECT '{n}' AS cut, count(*) FILTER ({c}) AS pairs, count(t.c_id) FILTER ({c}) AS found, round(count(t.c_id) FILTER ({c}) / (SELECT count(*) FROM truth), 9) AS recall FROM pairs q LEFT JOIN truth t ON t.s1_id = q.s1_id AND t.c_id = q.c_id" for n, c in cuts),
        "er_reduction": "SELECT *, round(1 - pairs / (entities * records), 9) AS reduction FROM (SELECT (SELECT count(*) FROM pairs) AS pairs, (SELECT count(*) FROM s1_business) AS entities, (SELECT count(*) FROM cand_business) AS records)",
        "er_number_features": "SELECT s1_id, c_id, num_p_in, num_p_first, round(num_frac1, 9) AS num_frac1, round(num_frac2, 9) AS num_frac2, num_logdiff, num_drop, num_del_any, num_long, CAST(n_nums1 AS INT) AS n_nums1, CAST(n_nums2 AS INT) AS n_nums2 FROM feats",
        "er_rarity": "SELECT s1_id, c_id, nm_idf_cov1, nm_idf_cov2, nm_idf_rare, ad_idf_cov1, ad_idf_cov2, ad_idf_rare FROM feats",
        "er_flag_features": "SELECT s1_id, c_id, c_f_alias, c_f_url, c_f_junk, c_f_empty_addr, c_f_pseudo, CAST(tok_diff AS INT) AS tok_diff, CAST(n_tok1 AS INT) AS n_tok1, c_s3, nm_exact, s1_name_n, c_name_n FROM feats",
        "er_jaro_winkler": "SELECT s1_id, c_id, round(jaro_winkler_similarity(a_core, b_core), 6) AS nm_jw FROM feats",
        "er_competition": f"""SELECT s1_id, c_id, p, sib, rank() OVER (PARTITION BY s1_id ORDER BY p DESC) AS e_rank, count(*) OVER e AS e_n, round(sum(p) OVER e, 9) AS e_sum, sum(sib) OVER e AS e_sib, max(p) OVER e AS e_max, round({margin('e')}, 9) AS e_margin,
  rank() OVER (PARTITION BY c_id ORDER BY p DESC) AS c_rank, count(*) OVER c AS c_n, max(p) OVER c AS c_max, round({margin('c')}, 9) AS c_margin, round(round(p / greatest(max(p) OVER e, 1e-6), 9), 6) AS e_rel FROM scored WINDOW e AS (PARTITION BY s1_id), c AS (PARTITION BY c_id)""",
        "er_coherence": """SELECT a.s1_id, a.c_id, b.p AS coh_p, b.c_id AS anchor_id, CASE WHEN len(x.nums[1:3]) > 0 AND len(z.nums[1:3]) > 0 THEN CAST(list_has_any(x.nums[1:3], z.nums[1:3]) AS DOUBLE) END AS coh_num
  FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, c_id) AS k FROM scored) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, c_id) AS k FROM scored) b ON a.s1_id = b.s1_id AND b.k = CASE WHEN a.k = 1 THEN 2 ELSE 1 END
  JOIN fin x ON x.entity_id = a.c_id LEFT JOIN fin z ON z.entity_id = b.c_id""",
        "er_owner": "SELECT s1_id, c_id, p FROM owned", "er_select": "SELECT s1_id, c_id, p FROM chosen", "er_decide": "SELECT s1_id, c_id, p FROM sel", "er_threshold": "SELECT s1_id, c_id, p FROM scored WHERE p >= 0.7",
        "er_per_entity": "SELECT * EXCLUDE (country) FROM ent",
        "er_slices": f"SELECT 'ALL' AS slice, '' AS value, {SUMMARY} FROM said UNION ALL SELECT 'country', country, {SUMMARY} FROM said GROUP BY country UNION ALL SELECT 'candidates', bin, {SUMMARY} FROM said GROUP BY bin" + "".join(
            f" UNION ALL SELECT '{name}', 'true', {SUMMARY} FROM said WHERE {c} HAVING count(*) > 0" for name, c in (("singleton", "n_gt = 0"), ("look_alike", "near"), ("unusual_name", "odd"), ("empty_address", "bare"))),
        "er_tuned_floor": f"""SELECT CAST(floor AS DOUBLE) AS floor, round(avg(CASE WHEN n_pred = 0 AND n_gt = 0 THEN 1.0 ELSE 1.25 * tp / (n_pred + 0.25 * n_gt) END), 9) AS f FROM (SELECT g.floor, s.entity_id, count(c.c_id) AS n_pred, count(t.c_id) AS tp, any_value(coalesce(n, 0)) AS n_gt
  FROM (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5]) AS floor) g CROSS JOIN (SELECT * FROM s1_business WHERE {u('entity_id')} < {SPLIT.valid}) s
  LEFT JOIN chosen c ON c.s1_id = s.entity_id AND c.p >= g.floor LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.c_id = c.c_id LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY s1_id) x ON x.s1_id = s.entity_id GROUP BY ALL) GROUP BY floor ORDER BY f DESC, floor LIMIT 1""",
        "er_lonely": "SELECT entity_id AS s1_id FROM s1_business WHERE entity_id NOT IN (SELECT s1_id FROM scored WHERE p >= 0.9)",
        "er_number_diff": f"""SELECT s1_id, c_id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS lost, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS other FROM (SELECT d.s1_id, d.c_id, {once('s.business_address')} AS a, {once('c.business_address')} AS b
  FROM decided d JOIN s1_business s ON s.entity_id = d.s1_id JOIN cand_business c ON c.entity_id = d.c_id)""",
        "er_entity": "SELECT s.entity_id AS s1_id, s.business_address AS s1_addr, d.c_id, c.business_address AS c_addr, d.p, d.selected FROM s1_business s LEFT JOIN decided d ON d.s1_id = s.entity_id LEFT JOIN cand_business c ON c.entity_id = d.c_id WHERE s.entity_id = 'S1-7'",
        "er_surplus": f"SELECT a.country, round(greatest(a.per_entity - b.per_entity, 0.0), 9) AS extra FROM {dens('cand_business')} a JOIN {dens('(SELECT * FROM cand_business WHERE NOT is_decoy)')} b USING (country)",
        "er_best_components": f"SELECT comp2, comp1, n, round(n / f2, 9) AS share, round(n * n / (f1 * f2), 9) AS cosine FROM ({comps})",
        "er_learned_components": f"SELECT comp2, comp1, n FROM ({comps}) WHERE n / f2 >= 0.1 AND f2 >= 2",
        "er_translit": f"""SELECT native, latin, n, round(n / total, 9) AS share FROM (SELECT *, sum(n) OVER (PARTITION BY native) AS total, row_number() OVER (PARTITION BY native ORDER BY n DESC, latin) AS k FROM (SELECT native, latin, count(*) AS n FROM (SELECT translate(unnest(b.name_tokens), '{GREEK[0]}', '{GREEK[1]}') AS native, unnest(a.name_tokens) AS latin
  FROM tr JOIN base a ON a.entity_id = tr.s1_id JOIN base b ON b.entity_id = tr.c_id WHERE len(a.name_tokens) = len(b.name_tokens)) WHERE regexp_matches(native, '[\\x{{0370}}-\\x{{FFFF}}]') AND regexp_matches(latin, '^[a-z]+$') GROUP BY ALL)) WHERE k = 1 AND n >= {N.translit_min_count} AND n / total >= {N.translit_min_share}""",
        "er_places": f"""SELECT q.s1_id, q.c_id, CAST(CASE WHEN len(a.l) > 0 AND len(b.l) > 0 THEN len(list_intersect(a.l, b.l)) END AS INT) AS loc_overlap FROM pairs q JOIN {places} a ON a.entity_id = q.s1_id JOIN {places} b ON b.entity_id = q.c_id""",
        "er_applied_lexicon": f"""SELECT entity_id, array_to_string(core, ' ') AS name_core, array_to_string(addr, ' ') AS addr_norm, coalesce(len(core) = 1 AND NOT f_url AND length(core[1]) >= 5 AND regexp_matches(core[1], '^[a-z]+$'), false) AS f_pseudo FROM (
  SELECT *, CASE WHEN len(list_filter(toks, lambda x: NOT list_contains({_list(T.LEGAL)}, x))) > 0 THEN list_filter(toks, lambda x: NOT list_contains({_list(T.LEGAL)}, x)) ELSE toks END AS core,
    list_filter(list_transform(list_filter(string_split(array_to_string(comps, ' '), ' '), lambda x: x <> ''), lambda x: coalesce({surface}[x], x)), lambda x: NOT list_contains({_list(T.ADDR_STOP)}, x)) AS addr FROM (
  SELECT entity_id, f_url, list_transform(toks0, lambda x: coalesce(MAP {{'red': 'rouge', 'blue': 'bleu', 'green': 'vert'}}[x], x)) AS toks,
    list_transform(addr_comps, lambda x: CASE WHEN country IN ('ASIA', 'EUROPE', 'AFRICA') AND regexp_replace(x, '^[0-9]+ ', '') = 'small street' THEN 'petite rue' ELSE regexp_replace(x, '^[0-9]+ ', '') END) AS comps
  FROM (SELECT *, list_transform(list_transform(name_tokens, lambda x: coalesce(MAP {{'red': 'rouge', 'blue': 'bleu', 'green': 'vert'}}[x], x)), lambda x: CASE WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '\\p{{L}}') THEN translate(x, '{T.HOMOGLYPHS[0]}', '{T.HOMOGLYPHS[1]}') ELSE x END) AS toks0 FROM base)))""",
        "er_end_to_end": f"SELECT {SUMMARY} FROM ent", "er_oracle_ceiling": f"SELECT {SUMMARY} FROM ceil",
        "er_pair_report": f"SELECT tp, fp, fn_candidates, tn, fn_blocking, round((tp + tn) / (tp + tn + fp + fn_candidates + fn_blocking), 9) AS accuracy, {SCORES.format('tp', 'fp', '(fn_candidates + fn_blocking)')} FROM (SELECT count(*) FILTER (selected AND y = 1) AS tp, count(*) FILTER (selected AND y = 0) AS fp, count(*) FILTER (NOT selected AND y = 1) AS fn_candidates, count(*) FILTER (NOT selected AND y = 0) AS tn, (SELECT count(*) FROM truth ANTI JOIN pairs USING (s1_id, c_id)) AS fn_blocking FROM decided)",
        "er_threshold_table": f"SELECT threshold, tp, fp, {SCORES.format('tp', 'fp', '(n - tp)')} FROM (SELECT CAST(threshold AS DOUBLE) AS threshold, sum(y) AS tp, sum(1 - y) AS fp, (SELECT count(*) FROM truth) AS n FROM scored JOIN (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS threshold) ON p >= threshold GROUP BY threshold)",
        "er_auc": f"""SELECT {auc('scored')}, threshold, f1 FROM (SELECT p AS threshold, round(2 * tp / (total + (SELECT sum(y) FROM scored)), 9) AS f1 FROM (SELECT p, sum(pos) OVER w AS tp, sum(pos + neg) OVER w AS total FROM (SELECT p, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM scored GROUP BY p) WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)) ORDER BY f1 DESC, p DESC LIMIT 1)""",
        "er_grid_floor": f"""SELECT CAST(floor AS DOUBLE) AS floor, round(avg(CASE WHEN n_pred = 0 AND n_gt = 0 THEN 1.0 ELSE 1.25 * tp / (n_pred + 0.25 * n_gt) END), 9) AS f FROM (SELECT g.floor, s.entity_id, count(c.c_id) AS n_pred, count(t.c_id) AS tp, any_value(coalesce(n, 0)) AS n_gt FROM {floors} g CROSS JOIN s1_business s
  LEFT JOIN chosen c ON c.s1_id = s.entity_id AND c.p >= g.floor LEFT JOIN truth t ON t.s1_id = c.s1_id AND t.c_id = c.c_id LEFT JOIN (SELECT s1_id, count(*) AS n FROM truth GROUP BY s1_id) x ON x.s1_id = s.entity_id GROUP BY ALL) GROUP BY floor""",
        "er_label_metrics": f"SELECT {auc('lab')}",
        "er_roles": f"SELECT entity_id, CASE WHEN {u('entity_id')} < {SPLIT.valid} THEN 'VALID' WHEN {u('entity_id')} < {SPLIT.valid + SPLIT.train} THEN 'TRAIN' WHEN {u('entity_id')} >= {1 - SPLIT.test} THEN 'TEST' ELSE 'UNUSED' END AS role, CAST(floor({u('entity_id', 'fold')} * 2) AS INT) AS fold FROM s1_business",
        "er_hash_sample": "SELECT entity_id FROM s1_business ORDER BY md5(concat(entity_id, 's')), entity_id LIMIT 100",
        "er_match_lists": "SELECT s.entity_id AS source1_entity_id, coalesce(string_agg(c_id, ',' ORDER BY c_id), '') AS matched_entity_ids FROM s1_business s LEFT JOIN sel ON sel.s1_id = s.entity_id GROUP BY s.entity_id",
        "er_truth_lists": "SELECT s1_id, c_id FROM truth", "er_orphans": "SELECT entity_id AS s1_id FROM s1_business WHERE entity_id NOT IN (SELECT s1_id FROM pairs)",
        "er_evidence": f"""SELECT s.entity_id AS s1_id, s.business_name AS s1_name, d.c_id, c.business_name AS c_name, d.p, CASE WHEN o.s1_id <> d.s1_id THEN o.s1_id END AS rival_id, CASE WHEN d.c_id IS NOT NULL THEN d.y END AS label, {verdict} AS verdict
  FROM s1_business s LEFT JOIN decided d ON d.s1_id = s.entity_id LEFT JOIN cand_business c ON c.entity_id = d.c_id LEFT JOIN owned o ON o.c_id = d.c_id""",
        "er_search": "SELECT entity_id AS s1_id, business_name AS s1_name, business_address AS s1_addr, country FROM s1_business WHERE contains(lower(business_name), 'red') ORDER BY entity_id LIMIT 20",
        "er_density": f"SELECT * FROM {dens('cand_business')}",
        "er_thinned": f"""SELECT d.entity_id, d.country FROM cand_business d JOIN {dens('(SELECT * FROM cand_business WHERE is_decoy)')} o USING (country) JOIN {dens('(SELECT * FROM cand_business WHERE NOT is_decoy)')} t USING (country)
  WHERE d.is_decoy AND {u('d.entity_id', 'thin')} < greatest(0.0, least(1.0, (t.per_entity + 0.2 - t.per_entity) / nullif(o.per_entity, 0)))""",
        "er_pseudo_labels": "SELECT s1_id, c_id, CAST(selected AND p >= 0.75 AS INT) AS y FROM decided WHERE s1_id IN (SELECT s1_id FROM decided GROUP BY s1_id HAVING bool_and(p >= 0.75 OR p <= 0.55))",
        "er_blend": "SELECT s1_id, c_id, round(CASE WHEN country IN ('ASIA', 'EUROPE') THEN p ELSE 0.7 * (p * p) + (1 - 0.7) * p END, 9) AS p FROM scored",
    }


def _with(base: list[tuple[str, str]]) -> str:
    chain = base + _entities("ent", "sel") + _entities("ceil", "(SELECT s1_id, c_id FROM pairs SEMI JOIN truth USING (s1_id, c_id))")
    chain += [("kc", "SELECT DISTINCT src, entity_id, unnest(list_transform(addr_comps, lambda x: concat_ws('|', country, x))) AS comp FROM base"),
              ("tr", f"SELECT * FROM truth WHERE (CAST(concat('0x', substr(md5(s1_id), 1, 8)) AS BIGINT) % 10000) / 10000 >= {SPLIT.valid} AND (CAST(concat('0x', substr(md5(s1_id), 1, 8)) AS BIGINT) % 10000) / 10000 < {SPLIT.valid + SPLIT.train}"),
              ("bc", f"SELECT src, entity_id, country, array_to_string(CASE WHEN len(list_filter(name_tokens, lambda x: NOT list_contains({_list(T.LEGAL)}, x))) > 0 THEN list_filter(name_tokens, lambda x: NOT list_contains({_list(T.LEGAL)}, x)) ELSE name_tokens END, ' ') AS name, all_nums[1] AS num, all_nums[1:3] AS n3 FROM base"),
              ("comp_pairs", """SELECT comp2, comp1, n, f1, f2 FROM (SELECT b.comp AS comp2, a.comp AS comp1, count(*) AS n FROM tr JOIN kc a ON a.entity_id = tr.s1_id JOIN kc b ON b.entity_id = tr.c_id GROUP BY ALL)
  JOIN (SELECT comp AS comp1, count(*) AS f1 FROM tr JOIN kc ON kc.entity_id = tr.s1_id GROUP BY ALL) USING (comp1) JOIN (SELECT comp AS comp2, count(*) AS f2 FROM tr JOIN kc ON kc.entity_id = tr.c_id GROUP BY ALL) USING (comp2)"""),
              ("places", f"SELECT comp, n, total FROM (SELECT comp, split_part(comp, '|', 1) AS country, count(*) AS n FROM kc WHERE src = 1 GROUP BY ALL) JOIN (SELECT country, count(*) AS total FROM s1_business GROUP BY country) USING (country) WHERE n / total >= {N.locality_min_share} AND NOT regexp_matches(comp, '[0-9]')"),
              ("said", """SELECT e.*, coalesce(odd, false) AS odd, coalesce(bare, false) AS bare, coalesce(near, false) AS near, CASE WHEN k IS NULL THEN '0' WHEN k <= 3 THEN '1-3' WHEN k <= 6 THEN '4-6' WHEN k <= 10 THEN '7-10' WHEN k <= 20 THEN '11-20' ELSE '>20' END AS bin FROM ent e
  LEFT JOIN (SELECT t.s1_id, bool_or(f_pseudo OR f_alias OR f_url) AS odd, bool_or(f_empty_addr) AS bare FROM truth t JOIN fin ON fin.entity_id = t.c_id GROUP BY t.s1_id) o ON o.s1_id = e.s1_id
  LEFT JOIN (SELECT d.s1_id, bool_or(d.y = 0 AND f.nm_exact = 1) AS near, count(*) AS k FROM scored d JOIN feats f ON f.s1_id = d.s1_id AND f.c_id = d.c_id GROUP BY d.s1_id) n ON n.s1_id = e.s1_id"""),
              ("lab", "SELECT CAST(n_chars AS DOUBLE) AS p, quality AS y FROM labels JOIN documents USING (doc_id)")]
    return ",\n".join(f"{n} AS MATERIALIZED ({q})" if n in ("base", "fin", "keys", "votes", "pairs", "feats", "scored", "owned", "chosen", "sel") else f"{n} AS ({q})" for n, q in chain)


def statements() -> dict[str, str]:
    text, whole = _with(_chain()), _with(_chain(rarity=""))
    return {name: f"WITH {whole if name == 'er_rarity' else text}\n{end}" for name, end in _endings().items()}
