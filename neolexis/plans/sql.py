"""The queries' SQL for DuckDB, written independently of the plans: dense grids, plain joins, window totals."""

from __future__ import annotations

import re

from ..config import SMALL

LEXICON = ["the", "and", "stupid", "idiot", "moron"]
_P = r"[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*"
CANDIDATE = "(length(token) >= 3 AND regexp_full_match(token, '[a-zA-Z]+([-''][a-zA-Z]+)*'))"
TOKEN_COLUMNS = "post_id, subreddit, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, year, month, CAST(week AS VARCHAR) AS week_start_date, token, surface, token_start, token_end"
_FIVE = "regexp_matches(token, '" + "|".join(f"{c}{{5,}}" for c in "abcdefghijklmnopqrstuvwxyz-") + "|''{5,}')"
_UNITS = " OR ".join(f"((length(token) - {r}) % {k} = 0 AND (length(token) - {r}) // {k} >= 3 AND left(token, length(token) - {r}) = repeat(left(token, {k}), (length(token) - {r}) // {k}))" for k in (1, 2, 3, 4) for r in (0, 1))
_LAUGHTER = f"(regexp_matches(token, '^(ha){{3,}}h?$|^(he){{3,}}h?$|^(lo){{3,}}l?$|^(um){{2,}}m?$|^(uh){{2,}}h?$') OR (length(token) >= 4 AND token = repeat(left(token, 1), length(token))) OR {_UNITS})"
_WORDS = ", ".join(f"'{w}'" for w in LEXICON)
_SHARED = ["count_reddit_all_time", "total_tokens_all_time", "p_reddit_all_time", "count_clean", "total_clean_tokens", "p_clean", "clean_ratio_score"]
_SPIKES = ["baseline_count_reddit", "baseline_total_tokens", "baseline_periods", "p_baseline", "p_current_smoothed", "p_baseline_smoothed", "spike_score"]
_META = [*_SHARED, "has_monthly_spike", "max_spike_score_monthly", "num_spike_periods_monthly", "has_yearly_spike", "max_spike_score_yearly", "num_spike_periods_yearly", "spike_profile"]
_FLAGS = ["is_profane", "is_typo", "is_reddit_jargon", "is_subreddit"]
_COMPONENTS = ["clean_component", "monthly_component", "yearly_component", "spike_boost", "reliability", "slang_score"]
_COLUMNS = {
    "ratio": ["token", "count_reddit", "total_tokens", "p_reddit", "count_clean", "total_clean_tokens", "p_clean", "clean_ratio_score"],
    "spike": ["token", "count_reddit", "total_tokens", "count_reddit_all_time", "p_reddit_all_time", "p_clean", "clean_ratio_score", "p_reddit", "period_id", *_SPIKES, "time_grain"],
    "cand": ["token", *_SHARED, "is_slang_candidate_clean_ratio", *_FLAGS],
    "spiking": ["token", *_SHARED, "is_slang_candidate_clean_ratio", *_FLAGS, "max_spike_score", "num_spike_periods", "is_slang_candidate_clean_ratio_spiking"],
    "combined": ["token", *_META, "is_slang_candidate_clean_ratio_spiking_combined"],
    "meta": _META,
    "cand_meta": _SHARED,
    "one_meta": [*_SHARED, "max_spike_score", "num_spike_periods"],
    "features": [c for c in _META[:-1] if not c.startswith("has_")],
}


def _double(c: str) -> bool:
    return c.startswith(("p_", "max_", "clean_ratio_score", "spike_score", "monthly_p_", "yearly_p_", "monthly_spike", "yearly_spike")) or c in _COMPONENTS


def rounded(kind: str) -> str:
    out = [f"round({c}, 9) AS {c}" if _double(c) else c for c in _COLUMNS[kind]]
    if kind == "features":
        out += [f"coalesce({c}, false) AS {c}" for c in ("has_monthly_spike", "has_yearly_spike")] + [f"round(coalesce({c}, 0.0), 9) AS {c}" for c in _COMPONENTS]
    return ", ".join(out)


def names(kind: str) -> list[str]:
    return list(_COLUMNS[kind])


_TIES = ["token", "subreddit", "corpus", "year", "month", "post_id", "token_start"]


def preview(mode: str, names: list[str], columns: str, source: str, order: list[tuple[str, bool]], *more: str) -> str:
    """First rows of a table by (column, falling) pairs and then by whatever tells rows apart; rounded after sorting."""
    keys = [(c, d) for c, d in order if c in names]
    keys += [(c, False) for c in _TIES if c in names and c not in dict(keys)]
    by = ", ".join(f"{c} {'DESC' if d else 'ASC'} NULLS LAST" for c, d in keys)
    out = ", ".join(f"round({c}, 9) AS {c}" if _double(c) else c for c in names)
    return sql(mode, f"SELECT {out} FROM (SELECT * FROM (SELECT {columns} FROM {source}) ORDER BY {by} LIMIT 20)", *more)


def _grain(g: str) -> list[str]:
    time = {"monthly": "year, month", "yearly": "year"}[g]
    period = "CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0')" if g == "monthly" else "CAST(year AS VARCHAR)"
    n = SMALL.window(g)
    return [
        f"per_{g} AS (SELECT DISTINCT {time} FROM st_{g})",
        f"tot_{g} AS (SELECT DISTINCT entity, {time}, total_tokens FROM st_{g})",
        f"grid_{g} AS (SELECT b.*, {', '.join('p.' + t for t in time.split(', '))}, coalesce(s.count_reddit, 0) AS c, coalesce(t.total_tokens, 0) AS t FROM broad b CROSS JOIN per_{g} p "
        + f"LEFT JOIN st_{g} s ON s.entity = b.entity AND s.token = b.token AND {' AND '.join(f's.{x} = p.{x}' for x in time.split(', '))} "
        + f"LEFT JOIN tot_{g} t ON t.entity = b.entity AND {' AND '.join(f't.{x} = p.{x}' for x in time.split(', '))})",
        f"win_{g} AS (SELECT *, sum(c) OVER w AS bc, sum(t) OVER w AS bt, sum(CASE WHEN t > 0 THEN 1 ELSE 0 END) OVER w AS bp FROM grid_{g} WINDOW w AS (PARTITION BY entity, token ORDER BY {time} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))",
        f"spike_{g} AS (SELECT entity, {time}, token, CAST(c AS BIGINT) AS count_reddit, CAST(t AS BIGINT) AS total_tokens, count_reddit_all_time, p_reddit_all_time, p_clean, clean_ratio_score, CASE WHEN t > 0 THEN c / t ELSE 0.0 END AS p_reddit, {period} AS period_id, "
        + "CAST(bc AS BIGINT) AS baseline_count_reddit, CAST(bt AS BIGINT) AS baseline_total_tokens, CAST(bp AS BIGINT) AS baseline_periods, CASE WHEN bt > 0 THEN bc / bt ELSE 0.0 END AS p_baseline, (c + 1.0) / (t + 1.0) AS p_current_smoothed, (bc + 1.0) / (bt + 1.0) AS p_baseline_smoothed, "
        + f"ln(((c + 1.0::DOUBLE) / (t + 1.0::DOUBLE)) / ((bc + 1.0::DOUBLE) / (bt + 1.0::DOUBLE))) AS spike_score, '{g}' AS time_grain FROM win_{g} WHERE bp >= {SMALL.min_baseline_periods} AND c >= {SMALL.min_period_count} AND bt >= {SMALL.min_baseline_total_tokens})",
        f"ev_{g} AS (SELECT entity, token, max(spike_score) AS max_spike_score, count(DISTINCT period_id) AS num_spike_periods FROM spike_{g} WHERE spike_score >= {SMALL.min_spike_score} GROUP BY ALL)",
        f"all_{g} AS (SELECT entity, token, max(spike_score) AS max_spike_score_{g}, count(DISTINCT period_id) AS num_spike_periods_{g} FROM spike_{g} GROUP BY ALL)",
        f"spiking_{g} AS (SELECT cand.*, max_spike_score, num_spike_periods, true AS is_slang_candidate_clean_ratio_spiking FROM cand JOIN ev_{g} USING (entity, token) WHERE num_spike_periods >= {SMALL.min_spike_periods})",
    ]


def _ctes(mode: str) -> list[str]:
    entity = "subreddit" if mode == "subreddit" else "'reddit'"

    def stats(g: str, time: str) -> str:
        keys = f"entity, {time}" if time else "entity"
        return f"st_{g} AS (SELECT {keys}, token, count_reddit, total_tokens, count_reddit / total_tokens AS p_reddit FROM (SELECT {keys}, token, CAST(sum(n) AS BIGINT) AS count_reddit FROM sb WHERE cand GROUP BY ALL) JOIN (SELECT {keys}, CAST(sum(n) AS BIGINT) AS total_tokens FROM sb GROUP BY ALL) USING ({keys}))"

    order = "power DESC, entity, token" if mode == "subreddit" else "power DESC, token"
    sig = lambda x, c, s: f"1 / (1 + exp(-(({x} - {c}) / {s})))"
    p = SMALL
    components = f"{sig('clean_ratio_score', p.clean_ratio_c, p.clean_ratio_s)} AS clean_component, {sig('coalesce(max_spike_score_monthly, 0.0)', p.spike_monthly_c, p.spike_monthly_s)} AS monthly_component, {sig('coalesce(max_spike_score_yearly, 0.0)', p.spike_yearly_c, p.spike_yearly_s)} AS yearly_component"
    side = lambda g: f"(SELECT entity, token, {', '.join(f'{c} AS {c}_{g[0]}' for c in _SHARED)}, max_spike_score AS max_spike_score_{g}, num_spike_periods AS num_spike_periods_{g} FROM spiking_{g})"
    return [
        "posts AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, source AS subreddit, o_orderdate AS ts, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, text AS body, CAST(floor(o_totalprice) AS INTEGER) AS score FROM documents JOIN orders ON o_orderkey = doc_id WHERE doc_id IS NOT NULL AND source IS NOT NULL AND o_orderdate IS NOT NULL AND text IS NOT NULL AND text NOT IN ('[deleted]', '[removed]'))",
        f"cut AS (SELECT post_id, subreddit, ts, year, month, week, regexp_extract_all(body, '{_P}') AS t, string_split_regex(body, '{_P}') AS g FROM posts)",
        "ex AS (SELECT post_id, subreddit, ts, year, month, week, unnest(t) AS surface, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS i FROM cut)",
        "tokens AS (SELECT post_id, subreddit, ts, year, month, week, lower(surface) AS token, surface, CAST(sum(length(gap) + length(surface)) OVER w - length(surface) AS INTEGER) AS token_start, CAST(sum(length(gap) + length(surface)) OVER w AS INTEGER) AS token_end FROM ex WINDOW w AS (PARTITION BY post_id ORDER BY i ROWS UNBOUNDED PRECEDING))",
        f"sb AS (SELECT {entity} AS entity, year, month, token, count(*) AS n, {CANDIDATE} AS cand FROM tokens GROUP BY ALL)",
        f"ct AS (SELECT lower(unnest(regexp_extract_all(text, '{_P}'))) AS token FROM conversations)",
        "clean AS (SELECT token, count(*) AS count_clean, CAST(sum(count(*)) OVER () AS BIGINT) AS total_clean_tokens, count(*) / sum(count(*)) OVER () AS p_clean FROM ct GROUP BY token)",
        stats("monthly", "year, month"), stats("yearly", "year"), stats("all_time", ""),
        "ratio AS (SELECT s.*, count_clean, total_clean_tokens, p_clean, ln(p_reddit / coalesce(p_clean, 1e-12::DOUBLE)) AS clean_ratio_score FROM st_all_time s LEFT JOIN clean USING (token))",
        f"broad AS (SELECT entity, token, count_reddit AS count_reddit_all_time, p_reddit AS p_reddit_all_time, p_clean, clean_ratio_score FROM ratio WHERE count_reddit >= {p.min_token_count} AND clean_ratio_score >= {p.spike_min_clean_ratio_score})",
        f"cand AS (SELECT entity, token, count_reddit AS count_reddit_all_time, total_tokens AS total_tokens_all_time, p_reddit AS p_reddit_all_time, count_clean, total_clean_tokens, p_clean, clean_ratio_score, true AS is_slang_candidate_clean_ratio, {', '.join(f'false AS {f}' for f in _FLAGS)} FROM ratio WHERE count_reddit >= {p.min_token_count} AND clean_ratio_score >= {p.min_clean_ratio_score} AND token NOT IN ({_WORDS}) AND NOT {_FIVE})",
        *_grain("monthly"), *_grain("yearly"),
        f"combined AS (SELECT entity, token, {', '.join(f'coalesce({c}_m, {c}_y) AS {c}' for c in _SHARED)}, max_spike_score_monthly IS NOT NULL AS has_monthly_spike, max_spike_score_monthly, num_spike_periods_monthly, max_spike_score_yearly IS NOT NULL AS has_yearly_spike, max_spike_score_yearly, num_spike_periods_yearly, "
        + f"CASE WHEN max_spike_score_monthly IS NOT NULL AND max_spike_score_yearly IS NOT NULL THEN 'both' WHEN max_spike_score_monthly IS NOT NULL THEN 'monthly_only' ELSE 'yearly_only' END AS spike_profile, true AS is_slang_candidate_clean_ratio_spiking_combined FROM {side('monthly')} FULL JOIN {side('yearly')} USING (entity, token))",
        f"parts AS (SELECT entity, token, count_reddit AS count_reddit_all_time, total_tokens AS total_tokens_all_time, p_reddit AS p_reddit_all_time, count_clean, total_clean_tokens, p_clean, clean_ratio_score, max_spike_score_monthly, num_spike_periods_monthly, max_spike_score_yearly, num_spike_periods_yearly, max_spike_score_monthly IS NOT NULL AS has_monthly_spike, max_spike_score_yearly IS NOT NULL AS has_yearly_spike, {components} FROM ratio LEFT JOIN all_monthly USING (entity, token) LEFT JOIN all_yearly USING (entity, token))",
        "features AS (SELECT *, greatest(monthly_component, yearly_component) AS spike_boost, least(1.0, ln(1 + count_reddit_all_time) / ln(101::DOUBLE)) AS reliability, least(1.0, ln(1 + count_reddit_all_time) / ln(101::DOUBLE)) * clean_component * (0.4 + 0.6 * greatest(monthly_component, yearly_component)) AS slang_score FROM parts)",
        f"raws AS (SELECT entity, token, pow(least(1.0, ln(1 + count_reddit_all_time) / ln({p.reliability_log}::DOUBLE)) * clean_component * ((1.0 - {p.spike_boost_weight}) + {p.spike_boost_weight} * greatest(monthly_component, yearly_component)), {p.power_transform}) AS raw FROM parts WHERE token NOT IN ({_WORDS}) AND NOT {_FIVE} AND NOT {_LAUGHTER})",
        "powers AS (SELECT *, round(raw, 12) AS power FROM raws)",
        f"ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM powers)",
    ]


def plotting(entity: str) -> str:
    def one(g: str, month: str) -> str:
        time = "year, month" if g == "monthly" else "year"
        spikes = ", ".join((f"round(s.{c}, 9)" if _double(c) else f"s.{c}") + f" AS {x}_{c}" if x == g else f"NULL AS {x}_{c}" for x in ("monthly", "yearly") for c in _SPIKES)
        meta = ", ".join(f"round(c.{c}, 9) AS {c}" if _double(c) else f"c.{c}" for c in _META)
        return f"SELECT {entity}, token, '{g}' AS time_grain, year, {month} AS month, s.period_id, t.count_reddit, t.total_tokens, round(t.p_reddit, 9) AS p_reddit, {meta}, {spikes} FROM st_{g} t JOIN combined c USING (entity, token) LEFT JOIN (SELECT entity, token, {time}, period_id, {', '.join(_SPIKES)} FROM spike_{g}) s USING (entity, token, {time})"

    return one("monthly", "month") + " UNION ALL " + one("yearly", "NULL")


def sql(mode: str, final: str, *more: str) -> str:
    """A query over the chain of CTEs that it needs."""
    chain = [*_ctes(mode), *more]
    needed, text = [], final
    for cte in reversed(chain):
        name = cte.split(" AS ", 1)[0]
        if re.search(rf"\b{name}\b", text):
            needed.insert(0, cte)
            text += " " + cte
    return f"WITH {', '.join(needed)} {final}"
