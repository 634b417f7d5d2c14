"""SQL twins of the registered queries, written for DuckDB over the same Parquet tables.

The SQL works from long rows throughout (every dataset of the sweep is built post by post), while the queries
take shorter ways, so agreement checks those as well.
"""

from __future__ import annotations

from tiltmeter.config import SYNTHETIC_TEXTS, NegativeCuts, Sweep

SWEEP = Sweep()
POSITIVE = (
    "'accelerates','accumulating','accumulation','aggressively','breakout','bullish','buyers','buying','gaining',"
    "'good','great','huge','massive','momentum','positive','strong','stronger','up','upside'"
)
NEGATIVE = (
    "'bad','bearish','collapsing','crash','crashing','down','downside','drop','dump','exit','fading','heavy','loss',"
    "'negative','panic','risk','rush','sell','weak'"
)
# Whitespace as a Unicode property plus four ASCII separators.
SPACE = r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def r6(expr: str) -> str:
    return f"(round({expr} + 1e-9::DOUBLE, 6) + 0.0)"


def half_even(expr: str, digits: int) -> str:
    """Round the shortest decimal form of a double, halves to even."""
    scaled = f"CAST(CAST({expr} AS VARCHAR) AS DECIMAL(28, 20)) * {10 ** digits}"
    return (
        f"(list_transform([{scaled}], lambda d: CAST(CASE WHEN d - floor(d) = 0.5 THEN 2 * floor((floor(d) + 1) / 2.0)"
        f" ELSE floor(d + 0.5) END AS DOUBLE))[1] / {10 ** digits})"
    )


def stamp(expr: str) -> str:
    return f"strftime({expr}, {STAMP})"


def second(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def draw(purpose: str, key: str) -> str:
    return f"(('0x' || substr(md5('{SWEEP.seed}|{purpose}|' || {key}), 1, 8))::BIGINT)"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"(CASE WHEN {whole} > 0 THEN round_even({part}::DOUBLE / {whole} * 100, {digits}) ELSE 0.0 END)"


def share_text(part: str, whole: str) -> str:
    return f"printf('%d/%d (%.1f%%)', {part}, {whole}, {pct(part, whole, 1)})"


def words(text: str, vocabulary: str) -> str:
    return f"len(list_filter(string_split_regex(lower({text}), '[^a-z]+'), lambda w: w IN ({vocabulary})))"


def strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACE}', ''), '{SPACE}$', '')"


def dominant(p: str, u: str, n: str) -> str:
    return (
        f"CASE WHEN {p} >= {u} AND {p} >= {n} THEN 'positive' WHEN {u} >= {n} THEN 'neutral' ELSE 'negative' END"
    )


def action_rank(cells: str, keys: str, before: str, after: str) -> str:
    """The three most frequent changes per key as one string."""
    return f"""
        SELECT {keys}, string_agg(name || ':' || n, ' | ' ORDER BY rk) AS txt FROM (
          SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, seen) AS rk FROM (
            SELECT {keys}, {before} || '>' || {after} AS name, count(*) AS n, min(window_id) AS seen
            FROM {cells} WHERE {before} <> {after} GROUP BY ALL))
        WHERE rk <= 3 GROUP BY ALL"""


SCORED = """
scored AS (
  SELECT CAST(event_id AS VARCHAR) AS tweet_id, ts, event_id, event_type, user_id, value,
         CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS coin,
         (least(value, 100.0::DOUBLE) - 41.0::DOUBLE) / 200.0::DOUBLE AS score,
         CASE WHEN value > 81 THEN 'positive' WHEN value < 5 THEN 'negative' ELSE 'neutral' END AS label,
         CAST(50 + event_id % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS conf
  FROM events)"""

_FEATURES = """
  SELECT *, coin || '_' || strftime(w, '%Y%m%dT%H%M%SZ') AS window_id, w + INTERVAL 6 HOUR AS w_end,
         pos / n::DOUBLE AS rp, neu / n::DOUBLE AS ru, neg / n::DOUBLE AS rn,
         CASE WHEN pos >= neu AND pos >= neg THEN 'positive' WHEN neu >= neg THEN 'neutral' ELSE 'negative' END AS dom
  FROM (SELECT dataset, coin, time_bucket(INTERVAL '6 hours', ts) AS w, count(*) AS n,
               count(*) FILTER (WHERE syn) AS n_syn, count(*) FILTER (WHERE label = 'positive') AS pos,
               count(*) FILTER (WHERE label = 'neutral') AS neu, count(*) FILTER (WHERE label = 'negative') AS neg,
               avg(score) AS mean, stddev_pop(score) AS std, avg(abs(score)) AS intensity, avg(conf) AS mconf
        FROM {rows} GROUP BY ALL)"""

_REGIME = """
  SELECT *, CASE WHEN n < 20 THEN 'sparse' WHEN rp >= 0.35 AND rn >= 0.35 THEN 'high_conflict'
                 WHEN abs(mean) <= 0.15 AND rp < 0.45 AND rn < 0.45 THEN 'neutral' WHEN rp >= 0.6 THEN 'positive_skew'
                 WHEN rn >= 0.6 THEN 'negative_skew' ELSE 'mixed' END AS regime FROM ({inner})"""


def features(rows: str) -> str:
    return _REGIME.format(inner=_FEATURES.format(rows=rows))


_SENTIMENT = " UNION ALL ".join(
    f"SELECT '{SWEEP.name('sentiment', f)}' AS dataset, 'sentiment' AS family, {f}::DOUBLE AS strength,"
    f" 'sentiment_amplification_k{f:g}' AS kind, tweet_id, ts, coin, label,"
    f" greatest(-1.0::DOUBLE, least(1.0::DOUBLE, score * {f}::DOUBLE)) AS score, conf, false AS syn, '' AS adv FROM scored"
    for f in SWEEP.factors
)
_JITTER = " UNION ALL ".join(
    f"SELECT '{SWEEP.name('jitter', m)}', 'jitter', {m}::DOUBLE, 'temporal_jitter_pm{m}min', tweet_id,"
    f" ts + to_minutes({draw('jitter', 'tweet_id')} % {2 * m + 1} - {m}), coin, label, score, conf, false, '' FROM scored"
    for m in SWEEP.jitters
)
_ORIGINALS = " UNION ALL ".join(
    f"SELECT '{SWEEP.name('injection', r)}', 'injection', {r}::DOUBLE, 'adversarial_original_r{r:.2f}', tweet_id, ts, coin,"
    f" label, score, conf, false, '' FROM scored"
    for r in SWEEP.ratios
)
_RATIOS = ", ".join(f"('{SWEEP.name('injection', r)}', {r}::DOUBLE, '{r:.2f}')" for r in SWEEP.ratios)
_TEXTS = ", ".join(
    f"('{symbol}', '{polarity}', {i}, '{body}')"
    for (symbol, polarity), bodies in SYNTHETIC_TEXTS.items() for i, body in enumerate(bodies)
)

INJECTION = f"""
base_rows AS (SELECT 'baseline' AS dataset, tweet_id, ts, coin, label, score, conf, false AS syn FROM scored),
base_win AS ({features('base_rows')}),
big AS (SELECT *, abs(mean) AS amean FROM base_win WHERE n >= 20),
candidates AS (SELECT * FROM big WHERE amean <= 0.08
               UNION ALL SELECT * FROM big WHERE NOT EXISTS (SELECT 1 FROM big WHERE amean <= 0.08)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY n DESC, amean, intensity, w) AS rk
                          FROM candidates) WHERE rk <= 8),
directed AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY coin ORDER BY mean, w)
                                 <= ceil(count(*) OVER (PARTITION BY coin) / 2.0)
                            THEN 'positive_injection' ELSE 'negative_injection' END AS d0 FROM chosen),
targets AS (SELECT * EXCLUDE (d0), CASE WHEN (SELECT count(DISTINCT d0) FROM directed) = 1 AND (SELECT count(*) FROM directed) >= 2
                   THEN CASE WHEN row_number() OVER (ORDER BY mean, coin, w) <= ceil(count(*) OVER () / 2.0)
                             THEN 'positive_injection' ELSE 'negative_injection' END
                   ELSE d0 END AS direction FROM directed),
plan AS (SELECT t.*, r.name AS inj, r.ratio, r.txt AS ratio_txt,
                least(75, greatest(3, ceil(t.n * r.ratio)))::BIGINT AS k
         FROM targets t CROSS JOIN (VALUES {_RATIOS}) AS r(name, ratio, txt)),
posts0 AS (SELECT *, CASE WHEN direction = 'positive_injection' THEN 'positive' ELSE 'negative' END AS polarity,
                  'synthetic:combined_adversarial:r' || ratio_txt || ':' || direction || ':' || window_id || ':' || i AS sid
           FROM (SELECT *, unnest(range(k)) AS i FROM plan)),
posts1 AS (SELECT p.*, t.body,
                  w + to_seconds({draw('offset', 'sid')} % 21599 + 1) AS sts
           FROM posts0 p JOIN (VALUES {_TEXTS}) AS t(symbol, pol, idx, body)
             ON t.symbol = p.coin AND t.pol = p.polarity AND t.idx = {draw('text', 'p.sid')} % 3),
posts2 AS (SELECT *, {words('body', POSITIVE)} AS wp, {words('body', NEGATIVE)} AS wn FROM posts1),
synthetic AS (SELECT *, wp::DOUBLE / (wp + wn + 1) AS pp, 1::DOUBLE / (wp + wn + 1) AS pu, wn::DOUBLE / (wp + wn + 1) AS pn
              FROM posts2)"""

_SYNTHETIC_ROWS = (
    f"SELECT inj, 'injection', ratio, 'combined_adversarial_injection_r' || ratio_txt, sid, sts, coin,"
    f" {dominant('pp', 'pu', 'pn')}, pp - pn, greatest(pp, pu, pn), true, direction FROM synthetic"
)

ROWS = f"""
rows AS (
  SELECT 'baseline' AS dataset, 'baseline' AS family, 0.0::DOUBLE AS strength, 'baseline' AS kind, tweet_id, ts, coin, label,
         score, conf, false AS syn, '' AS adv FROM scored
  UNION ALL {_SENTIMENT} UNION ALL {_JITTER} UNION ALL {_ORIGINALS} UNION ALL {_SYNTHETIC_ROWS})"""

REGISTRY = "registry AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{v.dataset}', '{v.family}', {v.strength}::DOUBLE, '{v.label}', {str(v.is_main).lower()})" for v in SWEEP.variants()
) + ") AS r(dataset, family, strength, label, is_main))"

DECISIONS = f"""
win AS ({features('rows')}),
risky AS (SELECT *, coalesce(std > 0.30 AND rn > 0.08, false) AS hit FROM win),
choices AS (
  SELECT *, 'deterministic' AS agent, CASE WHEN mean > 0.04 THEN 'BUY' WHEN mean < -0.01 THEN 'SELL' ELSE 'HOLD' END AS policy FROM risky
  UNION ALL
  SELECT *, 'model', CASE WHEN rp - rn > 0.12 THEN 'BUY' WHEN rp - rn <= 0.0 THEN 'SELL' ELSE 'HOLD' END FROM risky),
dec AS (SELECT *, CASE WHEN hit THEN 'HOLD' ELSE policy END AS act FROM choices),
pairs AS (SELECT m.*, b.act AS act0 FROM dec m JOIN dec b
          ON b.dataset = 'baseline' AND b.agent = m.agent AND b.window_id = m.window_id AND m.dataset <> 'baseline'),
duo AS (SELECT a.dataset, a.window_id, a.coin, a.w, a.act AS act1, b.act AS act2, a.hit AS hit1, b.hit AS hit2
        FROM dec a JOIN dec b ON a.dataset = b.dataset AND a.window_id = b.window_id
        WHERE a.agent = 'deterministic' AND b.agent = 'model')"""

MARKET = """
market AS (
  SELECT event_id AS step, ts, CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS coin, event_type,
         greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 50.0::DOUBLE) / 50.0::DOUBLE)) AS mood,
         CAST((event_id * 13) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS news,
         CAST((event_id * 37) % 101 AS DOUBLE) AS rsi, CAST((event_id * 53) % 101 AS DOUBLE) AS vol,
         CAST((event_id * 29) % 101 AS DOUBLE) AS fg,
         CAST((event_id * 17) % 41 - 20 AS DOUBLE) / CAST(2 AS DOUBLE) AS chg
  FROM events),
louder AS (SELECT * REPLACE (greatest(-1.0::DOUBLE, least(1.0::DOUBLE, mood * 2.0::DOUBLE)) AS mood) FROM market)"""


def rule_log(source: str) -> str:
    return f"""
  SELECT *, vol > 90 AS hit, CASE WHEN vol > 90 THEN 'HOLD' ELSE policy END AS act FROM (
    SELECT *, CASE WHEN mood > 0.5 AND rsi < 70 THEN 'BUY' WHEN mood < -0.3 OR rsi > 80 THEN 'SELL' ELSE 'HOLD' END AS policy
    FROM {source})"""


def composite_log(source: str) -> str:
    return f"""
  SELECT *, vol > 90 AS hit, CASE WHEN vol > 90 THEN 'HOLD' ELSE policy END AS act FROM (
    SELECT *, CASE raw_label WHEN 'positive' THEN 'BUY' WHEN 'negative' THEN 'SELL' ELSE 'HOLD' END AS policy FROM (
      SELECT *, CASE WHEN total > 0.30 THEN 'positive' WHEN total < -0.20 THEN 'negative' ELSE 'neutral' END AS raw_label FROM (
        SELECT *, 0.5::DOUBLE * mood + 0.25::DOUBLE * f_rsi + 0.15::DOUBLE * f_mom + 0.1::DOUBLE * f_fg AS total FROM (
          SELECT *, -(rsi - 50) / 50 AS f_rsi, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, chg / 10.0::DOUBLE)) AS f_mom,
                 (fg - 50) / 50 AS f_fg FROM {source}))))"""


LOGS = f"""{MARKET},
rule AS ({rule_log('market')}), rule2 AS ({rule_log('louder')}),
comp AS ({composite_log('market')}), comp2 AS ({composite_log('louder')}),
exps AS (SELECT 'baseline' AS experiment, step, act, hit, chg FROM rule UNION ALL SELECT 'intensity', step, act, hit, chg FROM rule2
         UNION ALL SELECT 'lag', step, act, hit, chg FROM rule),
exp_pnl AS (SELECT *, (CASE act WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END) * (chg / 100.0::DOUBLE) * 1000.0::DOUBLE AS pnl FROM exps),
totals AS (SELECT experiment, sum(pnl) AS total_pnl, count(*) FILTER (WHERE act <> 'HOLD') AS trades,
                  count(*) FILTER (WHERE act <> 'HOLD' AND pnl > 0) AS wins,
                  count(*) FILTER (WHERE act <> 'HOLD' AND pnl < 0) AS losses FROM exp_pnl GROUP BY ALL),
compared AS (SELECT m.experiment, b.total_pnl AS pnl_a, m.total_pnl AS pnl_b, m.total_pnl - b.total_pnl AS delta
             FROM totals m JOIN totals b ON b.experiment = 'baseline' WHERE m.experiment <> 'baseline')"""

RAW = f"""
docs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS idx, text, lang, source,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id % 24)::INT) + to_minutes((doc_id % 60)::INT) AS ts,
         'user' || (doc_id % 7) AS username, regexp_replace(text, '{SPACE}', ' ', 'g') AS squeezed FROM documents),
clean0 AS (SELECT *, trim(squeezed) AS body FROM docs WHERE length(trim(squeezed)) > 0),
found AS (SELECT *, source = 'src0' OR regexp_matches(body, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])ble($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])') AS btc,
                 source = 'src1' OR regexp_matches(body, '(?i)(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])ing($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])') AS eth FROM clean0),
topics AS (SELECT *, unnest(list_filter([CASE WHEN btc THEN 'BTC' END, CASE WHEN eth THEN 'ETH' END], lambda t: t IS NOT NULL)) AS coin
           FROM found)"""

W_POS, W_NEG = "'ing','ble','the'", "'tion','and','les'"

LABELLED = f"""{RAW},
counted AS (SELECT *, {words('text', W_POS)} AS wp, {words('text', W_NEG)} AS wn, {strip('text')} AS post FROM docs),
probs AS (SELECT *, wp::DOUBLE / (wp + wn + 1) AS pp, 1::DOUBLE / (wp + wn + 1) AS pu, wn::DOUBLE / (wp + wn + 1) AS pn FROM counted),
labelled AS (SELECT *, {dominant('pp', 'pu', 'pn')} AS label,
                    CASE WHEN source = 'src0' THEN 'BTC' WHEN source = 'src1' THEN 'ETH' WHEN lang = 'fr' THEN 'ADA'
                         WHEN lang = 'en' THEN 'DOGE' ELSE 'CRYPTO' END AS coin,
                    row_number() OVER (ORDER BY ts, idx) - 1 AS step FROM probs),
mood1 AS (SELECT *, CASE label WHEN 'positive' THEN 1.0::DOUBLE WHEN 'negative' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS mood FROM labelled),
mood2 AS (SELECT * REPLACE (greatest(-1.0::DOUBLE, least(1.0::DOUBLE, mood * 0.5::DOUBLE)) AS mood), mood AS news FROM mood1)"""


def derived(source: str) -> str:
    return f"""
  SELECT *, least(100, greatest(0, 50 + 50 * avg(mood) OVER (ORDER BY step ROWS 13 PRECEDING))) AS rsi,
         least(100, greatest(0, 100 * coalesce(stddev_samp(mood) OVER (ORDER BY step ROWS 9 PRECEDING), 0))) AS vol,
         3.0::DOUBLE * coalesce(lag(mood) OVER (ORDER BY step), 0) AS chg FROM {source}"""


WINDOW_SELECT = f"""
  window_id, {stamp('w')} AS window_start, {stamp('w_end')} AS window_end, coin AS cryptocurrency, n AS tweet_count,
  n_syn AS synthetic_count, pos AS positive_count, neu AS neutral_count, neg AS negative_count,
  {r6('rp')} AS positive_ratio, {r6('ru')} AS neutral_ratio, {r6('rn')} AS negative_ratio,
  {r6('mean')} AS mean_sentiment_score, {r6('std')} AS sentiment_std, {r6('intensity')} AS sentiment_intensity,
  {r6('mconf')} AS mean_sentiment_confidence, dom AS dominant_label, regime"""

TRAJECTORY_SELECT = f"""
  window_id, {second('w')} AS window_start, coin AS cryptocurrency, n AS tweet_count, {r6('mean')} AS mean_sentiment,
  {r6('std')} AS sentiment_std, {r6('rp')} AS positive_ratio, {r6('rn')} AS negative_ratio, n_syn AS synthetic_count,
  policy AS policy_action, act AS action_taken, hit AS oracle_triggered, agent, dataset"""

REG = "r.dataset, r.family, r.strength, r.label, r.is_main"


def on_events(body: str) -> str:
    return f"WITH {SCORED} {body}"


def on_baseline(body: str) -> str:
    return f"WITH {SCORED}, {INJECTION} {body}"


def on_sweep(body: str) -> str:
    return f"WITH {SCORED}, {INJECTION}, {ROWS}, {REGISTRY}, {DECISIONS} {body}"


def on_steps(body: str) -> str:
    return f"WITH {LOGS} {body}"


def on_docs(body: str) -> str:
    return f"WITH {RAW} {body}"


def on_labelled(body: str) -> str:
    return f"WITH {LABELLED} {body}"


_ADR_TABLE = f"""
  SELECT {REG}, c.agent, c.total AS matched_win, c.changed, {pct('c.changed', 'c.total')} AS "ADR_%", coalesce(f.txt, '') AS top_flips
  FROM (SELECT agent, dataset, count(*) AS total, count(*) FILTER (WHERE act <> act0) AS changed FROM pairs GROUP BY ALL) c
  JOIN registry r ON r.dataset = c.dataset
  LEFT JOIN ({action_rank('pairs', 'agent, dataset', 'act0', 'act')}) f ON f.agent = c.agent AND f.dataset = c.dataset"""

_CONSENSUS_TABLE = f"""
  SELECT {REG}, c.total AS total_windows, c.agree AS agree_windows, {pct('c.agree', 'c.total')} AS "consensus_%",
         c.h1 AS oracle_det, c.h2 AS oracle_model, coalesce(f.txt, '') AS top_disagree
  FROM (SELECT dataset, count(*) AS total, count(*) FILTER (WHERE act1 = act2) AS agree, count(*) FILTER (WHERE hit1) AS h1,
               count(*) FILTER (WHERE hit2) AS h2 FROM duo GROUP BY ALL) c
  JOIN registry r ON r.dataset = c.dataset
  LEFT JOIN ({action_rank('duo', 'dataset', 'act1', 'act2')}) f ON f.dataset = c.dataset"""

_ACTIONS = "(VALUES ('BUY'), ('SELL'), ('HOLD')) AS a(action)"

_RATIO_TABLE = """
  SELECT win.dataset, r.label, r.strength AS nominal, window_id, coin, n - n_syn AS original, n_syn,
         n_syn::DOUBLE / (n - n_syn) AS actual, n_syn >= 75 AS cap_hit
  FROM win JOIN registry r ON r.dataset = win.dataset AND r.family = 'injection' WHERE n_syn > 0"""

_POLICIES = {
    "standard": (0.04, -0.01, 0.30), "cautious": (0.08, -0.05, 0.30), "eager": (0.02, 0.0, 0.32),
    "no_override": (0.04, -0.01, 10.0),
}
_VARIANTS = "variants AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS variant, dataset, window_id, CASE WHEN std > {risk} AND rn > 0.08 THEN 'HOLD' WHEN mean > {buy} THEN 'BUY'"
    f" WHEN mean < {sell} THEN 'SELL' ELSE 'HOLD' END AS act FROM win"
    for name, (buy, sell, risk) in _POLICIES.items()
) + ")"

_CUTS = NegativeCuts()
_THRESHOLDS = ", ".join(
    [f"{share_text(f'count(*) FILTER (WHERE mean <= {c})', 'count(*)')} AS \"mean_sentiment <= {c:+.2f}\"" for c in _CUTS.mean_at_most]
    + [f"{share_text(f'count(*) FILTER (WHERE rn >= {c})', 'count(*)')} AS \"negative_ratio >= {c:.2f}\"" for c in _CUTS.ratio_at_least]
)


def _map_text(source: str, name: str) -> str:
    """A counted column as `a=1|b=2`."""
    return (
        f"(SELECT coalesce(string_agg(k || '=' || c, '|' ORDER BY k), '') FROM (SELECT {name} AS k, count(*) AS c FROM {source}"
        f" GROUP BY ALL))"
    )


def _drift(experiment: str, mutant: str) -> str:
    joined = f"rule a JOIN {mutant} b ON a.step = b.step"
    flips = _map_text(f"{joined} WHERE a.act <> b.act", "a.act || ' -> ' || b.act")
    return f"""
  SELECT count(*) AS total_steps, count(*) FILTER (WHERE a.act <> b.act) AS mismatched_steps,
         {r6("count(*) FILTER (WHERE a.act <> b.act)::DOUBLE / count(*)")} AS adr,
         count(*) FILTER (WHERE a.hit AND b.act <> 'HOLD') AS oracle_violations,
         {r6("count(*) FILTER (WHERE a.hit AND b.act <> 'HOLD')::DOUBLE / count(*)")} AS oracle_violation_rate,
         count(*) FILTER (WHERE a.hit) AS oracle_baseline, count(*) FILTER (WHERE b.hit) AS oracle_mutant,
         {flips} AS action_flips, '{experiment}' AS experiment
  FROM {joined}"""


_TEXT_DIGEST = "length({0}) AS text_length, md5({0}) AS text_md5"

_SCORES = f"""
  doc_id, {dominant('pp', 'pu', 'pn')} AS finbert_label, {r6('pp')} AS finbert_positive, {r6('pu')} AS finbert_neutral,
  {r6('pn')} AS finbert_negative, {r6('pp - pn')} AS sentiment_score, {r6('greatest(pp, pu, pn)')} AS sentiment_confidence"""

_MARKET_SELECT = f"""
  {stamp('ts')} AS "timestamp", coin AS cryptocurrency, step, {r6('mood')} AS social_sentiment_score,
  {r6('news')} AS news_impact_score, 100.0::DOUBLE AS current_price_usd, {r6('rsi')} AS rsi_technical_indicator,
  {r6('vol')} AS volatility_index, {r6('chg')} AS price_change_24h_percent"""

_SCORED_SELECT = f"""
  tweet_id, {stamp('ts')} AS "timestamp", coin AS cryptocurrency, {r6('score')} AS sentiment_score, label AS finbert_label,
  {r6('conf')} AS sentiment_confidence, false AS is_synthetic"""

_STEP_TEXT = """printf('%s moved %s %.1f%% with %s social sentiment. RSI is %s at %.1f. Fear and greed index is %.0f.', coin,
    CASE WHEN chg > 0 THEN 'up' ELSE 'down' END, round_even(abs(chg), 1),
    CASE WHEN mood > 0.05 THEN 'positive' WHEN mood < -0.05 THEN 'negative' ELSE 'neutral' END,
    CASE WHEN rsi > 70 THEN 'overbought' WHEN rsi < 30 THEN 'oversold' ELSE 'neutral' END, round_even(rsi, 1), round_even(fg, 0))"""

_PNL = "(CASE act WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END) * (chg / 100.0::DOUBLE) * 1000.0::DOUBLE"


def _sum_pnl(agent: str, log: str) -> str:
    return (
        f"SELECT '{agent}' AS agent, row_number() OVER (ORDER BY ts, step) - 1 AS step, act AS action_taken, {_PNL} AS pnl FROM {log}"
    )


ORACLES: dict[str, str] = {
    # sources and sinks
    "read_posts_csv": """
        SELECT CAST(doc_id AS VARCHAR) AS "index",
               '2024-01-01 ' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || ':00' AS "Date",
               text AS content, '[''' || source || ''', ''' || lang || ''']' AS "Hashtags", 'user' || (doc_id % 7) AS "Username",
               CAST(NULL AS VARCHAR) AS "URL"
        FROM documents""",
    "normalize_scored": on_events(f"""
        SELECT tweet_id, {stamp("date_trunc('second', ts)")} AS "timestamp", coin AS cryptocurrency,
               CASE WHEN tweet_id LIKE '%7' THEN NULL ELSE {r6('score')} END AS sentiment_score, {r6('conf')} AS finbert_positive,
               false AS is_synthetic,
               CASE WHEN tweet_id LIKE '%7' THEN 'neutral' WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative'
                    ELSE 'neutral' END AS finbert_label
        FROM scored"""),
    "scored_cache": on_events(f"SELECT {_SCORED_SELECT} FROM scored"),
    "finalize_dataset": on_events(f"""
        SELECT tweet_id, {stamp('ts')} AS "timestamp", coin AS cryptocurrency, label AS finbert_label,
               {r6('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, score * 1.5::DOUBLE))')} AS sentiment_score,
               {r6('conf')} AS sentiment_confidence, 'baseline' AS mutation_type, false AS is_synthetic,
               {r6('score')} AS sentiment_score_original, 'sentiment_1.5' AS dataset
        FROM scored"""),
    "csv_sink": on_sweep(_ADR_TABLE),
    "json_sink": on_baseline(f"""
        SELECT {TRAJECTORY_SELECT.replace('agent, dataset', "'deterministic' AS agent, '' AS dataset")}
        FROM (SELECT *, CASE WHEN hit THEN 'HOLD' ELSE policy END AS act FROM (
          SELECT *, std > 0.30 AND rn > 0.08 AS hit,
                 CASE WHEN mean > 0.04 THEN 'BUY' WHEN mean < -0.01 THEN 'SELL' ELSE 'HOLD' END AS policy FROM base_win))"""),
    "text_report": on_steps("""
        , d AS (SELECT count(*) AS n, count(*) FILTER (WHERE a.act <> b.act) AS m, count(*) FILTER (WHERE a.hit AND b.act <> 'HOLD') AS v
                FROM rule a JOIN rule2 b ON a.step = b.step)
        SELECT unnest(['Drift of decisions', printf('  steps            %d', n),
          printf('  changed          %d of all steps: %.2f %%', m, round_even(m::DOUBLE / n * 100, 2)),
          printf('  override broken  %d of all steps: %.2f %%', v, round_even(v::DOUBLE / n * 100, 2))]) AS value
        FROM d"""),
    "dataset_registry": on_sweep(f"""
        SELECT {REG}, c.windows FROM registry r JOIN (SELECT dataset, count(*) AS windows FROM win GROUP BY ALL) c ON c.dataset = r.dataset"""),
    "main_aliases": on_sweep("""
        SELECT 'main_' || r.family AS view, sum(n)::BIGINT AS posts FROM win JOIN registry r ON r.dataset = win.dataset
        WHERE r.is_main GROUP BY ALL"""),
    "dataset_qa": on_sweep(f"""
        SELECT {REG}, c.rows, c.synthetic_rows, c.positive_rows, c.negative_rows FROM registry r JOIN (
          SELECT dataset, count(*) AS rows, count(*) FILTER (WHERE syn) AS synthetic_rows,
                 count(*) FILTER (WHERE adv = 'positive_injection') AS positive_rows,
                 count(*) FILTER (WHERE adv = 'negative_injection') AS negative_rows FROM rows GROUP BY ALL) c ON c.dataset = r.dataset"""),
    "qa_violations": on_sweep("""
        SELECT dataset, 'row count changed' AS reason FROM (SELECT dataset, count(*) FILTER (WHERE NOT syn) AS c FROM rows GROUP BY ALL)
        WHERE c <> (SELECT count(*) FROM scored)
        UNION ALL
        SELECT r.dataset, 'one direction only' FROM registry r WHERE r.family = 'injection'
          AND (SELECT count(DISTINCT adv) FROM rows WHERE rows.dataset = r.dataset AND syn) < 2"""),
    # cleaning and text
    "normalize_text": on_docs("SELECT doc_id, trim(squeezed) AS text FROM docs"),
    "parse_tags": """
        SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source || '|' || lang WHEN 1 THEN source || '|' || lang WHEN 2 THEN source
                            WHEN 4 THEN source || '|12' ELSE '' END AS tags,
               CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS n_tags
        FROM documents""",
    "detect_topics": on_docs("SELECT idx AS \"index\", concat_ws('|', CASE WHEN btc THEN 'BTC' END, CASE WHEN eth THEN 'ETH' END) AS topics FROM found"),
    "tag_symbol": """
        SELECT CAST(doc_id AS VARCHAR) AS "index", CASE WHEN source = 'src0' THEN 'BTC' WHEN source = 'src1' THEN 'ETH'
               WHEN lang = 'fr' THEN 'ADA' WHEN lang = 'en' THEN 'DOGE' ELSE 'CRYPTO' END AS symbol FROM documents""",
    "explode_topics": on_docs("""
        SELECT idx AS source_row_id, coin AS cryptocurrency, idx || ':' || coin AS tweet_id, 'each' AS mode FROM topics
        UNION ALL
        SELECT idx, coins, idx || ':' || coins, 'joined'
        FROM (SELECT idx, concat_ws('_', CASE WHEN btc THEN 'BTC' END, CASE WHEN eth THEN 'ETH' END) AS coins FROM found) WHERE coins <> ''"""),
    "clean_posts": on_docs(f"""
        SELECT idx || ':' || coin AS tweet_id, idx AS source_row_id, {stamp('ts')} AS "timestamp", coin AS cryptocurrency,
               source || '|' || lang AS hashtags, '' AS url, username, false AS is_synthetic, 'baseline' AS mutation_type,
               '' AS adversarial_direction, '' AS target_window_id, 'crypto_10k' AS source, {_TEXT_DIGEST.format('body')}
        FROM topics"""),
    "dedup_posts": """
        SELECT doc_id, md5(text) AS text_md5, lang FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "label_from_score": on_events("""
        SELECT tweet_id, CASE WHEN score > 0.05 THEN 'positive' WHEN score < -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM scored"""),
    "parse_answer": """
        SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'BUY' WHEN 1 THEN 'SELL' WHEN 2 THEN 'SELL' ELSE 'HOLD' END AS action,
               CASE event_id % 6 WHEN 4 THEN 'positive' ELSE 'neutral' END AS sentiment FROM events""",
    "render_window_text": on_baseline(f"""
        SELECT window_id, printf('%s: %d tweets, mean_sentiment=%.3f, positive=%.0f%%, neutral=%.0f%%, negative=%.0f%%, sentiment_std=%.3f',
               coin, n, {half_even('mean', 3)} + 0.0, {half_even('rp * 100', 0)}, {half_even('ru * 100', 0)}, {half_even('rn * 100', 0)},
               {half_even('std', 3)}) AS text
        FROM base_win"""),
    "render_step_text": f"WITH {MARKET} SELECT step, {_STEP_TEXT} AS text FROM market",
    # scoring
    "probs_to_sentiment": f"""
        WITH p AS (SELECT event_id, (event_id % 5)::DOUBLE / 10.0::DOUBLE AS pp, (user_id % 5)::DOUBLE / 10.0::DOUBLE AS pn FROM events),
             q AS (SELECT *, 1.0::DOUBLE - pp - pn AS pu FROM p)
        SELECT event_id, {dominant('pp', 'pu', 'pn')} AS finbert_label, {r6('pp')} AS finbert_positive, {r6('pu')} AS finbert_neutral,
               {r6('pn')} AS finbert_negative, {r6('pp - pn')} AS sentiment_score, {r6('greatest(pp, pu, pn)')} AS sentiment_confidence
        FROM q""",
    "score_lexicon": on_labelled(f"SELECT {_SCORES} FROM probs"),
    "score_udf": on_labelled(f"SELECT {_SCORES} FROM probs"),
    "score_distinct": on_labelled(f"SELECT lang, {_SCORES} FROM probs"),
    "heuristic_policy": on_steps(f"""
        SELECT step, {stamp('ts')} AS "timestamp", coin AS cryptocurrency, {r6('mood')} AS input_sentiment, {r6('rsi')} AS rsi,
               {r6('vol')} AS volatility, 100.0::DOUBLE AS price_usd, {r6('chg')} AS price_change_pct, {r6('total')} AS composite, raw_label,
               printf('Composite=%+.3f | sentiment=%+.3f(x0.50) rsi_factor=%+.3f(x0.25) momentum=%+.3f(x0.15) fear_greed=%+.3f(x0.10) -> %s',
                 {half_even('total', 3)} + 0.0, {half_even('mood', 3)} + 0.0, {half_even('f_rsi', 3)} + 0.0,
                 {half_even('f_mom', 3)} + 0.0, {half_even('f_fg', 3)} + 0.0, raw_label) AS reasoning,
               policy AS policy_action, act AS action_taken, hit AS oracle_triggered, 'composite' AS agent
        FROM comp"""),
    "decide_bucketed": f"""
        WITH {MARKET},
        keyed AS (SELECT *, round_even(rsi / 5, 0) * 5 AS rb, round_even(vol / 5, 0) * 5 AS vb FROM market),
        asked AS (SELECT event_type, rb, vb, min(step) AS asked_at, arg_min(rsi, step) AS r0, arg_min(vol, step) AS v0 FROM keyed GROUP BY ALL),
        done AS (SELECT k.*, a.asked_at, CASE WHEN k.event_type IN ('click', 'view') AND r0 < 48 THEN 'BUY'
                        WHEN r0 + v0 > 121 THEN 'SELL' ELSE 'HOLD' END AS policy
                 FROM keyed k JOIN asked a ON a.event_type = k.event_type AND a.rb = k.rb AND a.vb = k.vb)
        SELECT step, policy AS policy_action, CASE WHEN vol > 90 THEN 'HOLD' ELSE policy END AS action_taken,
               vol > 90 AS oracle_triggered, asked_at, asked_at <> step AS cached,
               printf('saw RSI=%.0f Vol=%.0f -> decided=%s', rsi, vol, policy) || CASE WHEN asked_at <> step THEN ' (cached)' ELSE '' END
                 || CASE WHEN vol > 90 THEN printf(' -> override (vol=%.1f>90) -> HOLD', vol) ELSE '' END AS reasoning
        FROM done""",
    "model_agent": on_baseline(f"""
        SELECT {TRAJECTORY_SELECT.replace('agent, dataset', "'model' AS agent, '' AS dataset")}
        FROM (SELECT *, CASE WHEN hit THEN 'HOLD' ELSE policy END AS act FROM (
          SELECT *, std > 0.30 AND rn > 0.08 AS hit,
                 CASE WHEN round_even(rp * 100, 0) - round_even(rn * 100, 0) > 12 THEN 'BUY'
                      WHEN round_even(rp * 100, 0) - round_even(rn * 100, 0) < 0 THEN 'SELL' ELSE 'HOLD' END AS policy FROM base_win))"""),
    # perturbations
    "amplify": on_events(f"""
        SELECT tweet_id, {stamp('ts')} AS "timestamp", coin AS cryptocurrency,
               {r6('greatest(-1.0::DOUBLE, least(1.0::DOUBLE, score * 1.5::DOUBLE))')} AS sentiment_score, label AS finbert_label,
               {r6('conf')} AS sentiment_confidence, false AS is_synthetic, {r6('score')} AS sentiment_score_original,
               'sentiment_amplification_k1.5' AS mutation_type, 'sentiment' AS sweep_family, 1.5::DOUBLE AS sweep_strength
        FROM scored"""),
    "time_jitter": on_events(f"""
        , moved AS (SELECT *, {draw('jitter', 'tweet_id')} % 31 - 15 AS shift FROM scored)
        SELECT tweet_id, {stamp('ts + to_minutes(shift)')} AS "timestamp", coin AS cryptocurrency, {r6('score')} AS sentiment_score,
               label AS finbert_label, {r6('conf')} AS sentiment_confidence, false AS is_synthetic, {stamp('ts')} AS timestamp_original,
               shift::INT AS time_shift_minutes, 'temporal_jitter_pm15min' AS mutation_type, 'jitter' AS sweep_family,
               15.0::DOUBLE AS sweep_strength
        FROM moved"""),
    "row_lag": f"""
        WITH {MARKET} SELECT step, {r6("coalesce(lag(news, 3) OVER (ORDER BY step), (SELECT avg(news) FROM market))")} AS news_impact_score
        FROM market""",
    "market_frame": on_labelled(f"""
        , frame AS (SELECT * EXCLUDE (news) FROM ({derived("(SELECT *, mood AS news FROM mood1)")}))
        SELECT {_MARKET_SELECT.replace('round(news', 'round(mood')}, {_TEXT_DIGEST.format('post')} FROM frame"""),
    "emphasize": on_labelled(f"""
        , frame AS ({derived('mood2')})
        SELECT {_MARKET_SELECT}, {_TEXT_DIGEST.format("('[BREAKING] ' || post)")} FROM frame"""),
    "text_lag": on_labelled(f"""
        , late AS (SELECT step, coalesce(lag(post, 3) OVER (ORDER BY step), '[NO DATA — tweet feed not yet started]') AS body,
                          coalesce(lag(mood, 3) OVER (ORDER BY step), (SELECT avg(mood) FROM mood1)) AS news FROM mood1)
        SELECT step, {r6('news')} AS news_impact_score, {_TEXT_DIGEST.format('body')} FROM late"""),
    "select_targets": on_baseline(f"""
        SELECT window_id, coin AS cryptocurrency, n AS tweet_count, {r6('mean')} AS mean_sentiment_score,
               {r6('amean')} AS abs_mean_sentiment_score, direction AS adversarial_direction FROM targets"""),
    "injection_plan": on_baseline(f"""
        SELECT inj AS dataset, window_id, direction AS adversarial_direction, ratio AS nominal_injection_ratio, n AS original_tweet_count,
               k AS synthetic_count, {r6('k::DOUBLE / n')} AS actual_injection_ratio, k >= 75 AS cap_hit FROM plan"""),
    "inject_posts": on_baseline(f"""
        SELECT inj AS dataset, sid AS tweet_id, {stamp('sts')} AS "timestamp", coin AS cryptocurrency, body AS tweet_text,
               coin || '|' || CASE WHEN coin = 'BTC' THEN 'Bitcoin' ELSE 'Ethereum' END || '|crypto' AS hashtags, '' AS url,
               'synthetic_' || polarity AS username, true AS is_synthetic, 'combined_adversarial_injection_r' || ratio_txt AS mutation_type,
               direction AS adversarial_direction, window_id AS target_window_id, 'synthetic_adversarial' AS source,
               coin || '_' || polarity AS synthetic_template_id, ratio AS nominal_injection_ratio, n AS original_tweet_count,
               k AS synthetic_count_target, {r6('k::DOUBLE / n')} AS actual_injection_ratio, k >= 75 AS cap_hit,
               'injection' AS sweep_family, ratio AS sweep_strength
        FROM synthetic"""),
    "injected_dataset": on_sweep(f"""
        SELECT rows.tweet_id, {stamp('ts')} AS "timestamp", rows.coin AS cryptocurrency, label AS finbert_label, {r6('score')} AS sentiment_score,
               syn AS is_synthetic, kind AS mutation_type, adv AS adversarial_direction, coalesce(s.window_id, '') AS target_window_id,
               family AS sweep_family, strength AS sweep_strength
        FROM rows LEFT JOIN synthetic s ON s.sid = rows.tweet_id WHERE rows.dataset = 'injection_0.20'"""),
    "sweep": on_sweep(f"""
        SELECT dataset, tweet_id, {stamp('ts')} AS "timestamp", coin AS cryptocurrency, label AS finbert_label, {r6('score')} AS sentiment_score,
               {r6('conf')} AS sentiment_confidence, syn AS is_synthetic, kind AS mutation_type, family AS sweep_family,
               strength AS sweep_strength FROM rows"""),
    # windows
    "window_features": on_baseline(f"SELECT {WINDOW_SELECT} FROM base_win"),
    "sweep_windows": on_sweep(f"SELECT dataset, {WINDOW_SELECT} FROM win"),
    "regimes": on_sweep("SELECT dataset, window_id, dom AS dominant_label, regime FROM win"),
    "regime_counts": on_baseline("SELECT coin AS cryptocurrency, regime, count(*) AS windows FROM base_win GROUP BY ALL"),
    "busiest_windows": on_baseline("SELECT window_id, n AS tweet_count, regime FROM base_win ORDER BY coin, n DESC, w LIMIT 12"),
    "value_counts": on_events(f"""
        SELECT coin AS cryptocurrency, label AS finbert_label, count(*) AS count,
               {r6('count(*)::DOUBLE / (SELECT count(*) FROM scored)')} AS share FROM scored GROUP BY ALL"""),
    "load_summary": on_sweep("""
        SELECT dataset, sum(n)::BIGINT AS tweet_rows, count(*) AS windows, count(*) FILTER (WHERE coin = 'BTC') AS "BTC_windows",
               count(*) FILTER (WHERE coin = 'ETH') AS "ETH_windows", round_even(avg(mean), 4) + 0.0 AS mean_window_sentiment,
               round_even(stddev_samp(mean), 4) + 0.0 AS std_window_sentiment FROM win GROUP BY ALL"""),
    "negative_summary": on_sweep(f"""
        SELECT dataset, count(*) AS windows, round_even(avg(mean), 4) + 0.0 AS mean_sentiment_avg, round_even(min(mean), 4) + 0.0 AS mean_sentiment_min,
               round_even(quantile_cont(mean, 0.1), 4) + 0.0 AS mean_sentiment_p10, round_even(quantile_cont(mean, 0.5), 4) + 0.0 AS mean_sentiment_median,
               round_even(avg(rn), 4) + 0.0 AS negative_ratio_avg, round_even(quantile_cont(rn, 0.9), 4) + 0.0 AS negative_ratio_p90,
               round_even(max(rn), 4) + 0.0 AS negative_ratio_max,
               {share_text("count(*) FILTER (WHERE dom = 'negative')", 'count(*)')} AS dominant_negative,
               {share_text("count(*) FILTER (WHERE regime = 'negative_skew')", 'count(*)')} AS negative_skew,
               {share_text("count(*) FILTER (WHERE regime = 'high_conflict')", 'count(*)')} AS high_conflict
        FROM win GROUP BY ALL"""),
    "negative_thresholds": on_sweep(f"""
        SELECT dataset, count(*) AS windows, {_THRESHOLDS},
               {share_text('count(*) FILTER (WHERE mean <= -0.03 OR rn >= 0.15)', 'count(*)')} AS strong_negative_candidate
        FROM win GROUP BY ALL"""),
    "most_negative": on_sweep(f"""
        SELECT dataset, window_id, {stamp('w')} AS window_start, coin AS cryptocurrency, n AS tweet_count, pos AS positive_count,
               neu AS neutral_count, neg AS negative_count, {r6('rp')} AS positive_ratio, {r6('ru')} AS neutral_ratio, {r6('rn')} AS negative_ratio,
               {r6('mean')} AS mean_sentiment_score, {r6('std')} AS sentiment_std, dom AS dominant_label, regime
        FROM win QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY mean, rn DESC, window_id) <= 5"""),
    # decisions
    "window_policy": on_sweep("SELECT dataset, window_id, policy AS policy_action, hit AS oracle_triggered FROM dec WHERE agent = 'deterministic'"),
    "trajectory": on_sweep(f"SELECT {TRAJECTORY_SELECT} FROM dec WHERE agent = 'deterministic'"),
    "step_policy": on_steps(f"""
        SELECT step, {stamp('ts')} AS "timestamp", coin AS cryptocurrency, {r6('mood')} AS input_sentiment, {r6('rsi')} AS rsi,
               {r6('vol')} AS volatility, 100.0::DOUBLE AS price_usd, {r6('chg')} AS price_change_pct, policy AS policy_action,
               act AS action_taken, hit AS oracle_triggered, 'deterministic' AS agent FROM rule"""),
    "model_step_policy": f"""
        WITH {MARKET}, told AS (SELECT *, {_STEP_TEXT} AS body FROM market),
        counted AS (SELECT *, {words('body', "'up','positive','oversold'")} AS wp, {words('body', "'down','negative','overbought'")} AS wn FROM told),
        probs AS (SELECT *, wp::DOUBLE / (wp + wn + 1) AS pp, 1::DOUBLE / (wp + wn + 1) AS pu, wn::DOUBLE / (wp + wn + 1) AS pn FROM counted),
        labelled AS (SELECT *, {dominant('pp', 'pu', 'pn')} AS raw_label FROM probs),
        chosen AS (SELECT *, CASE raw_label WHEN 'positive' THEN 'BUY' WHEN 'negative' THEN 'SELL' ELSE 'HOLD' END AS policy FROM labelled)
        SELECT step, raw_label, printf('model: %s (conf=%.2f) | %s', raw_label, round_even(greatest(pp, pu, pn), 2), body) AS reasoning,
               policy AS policy_action, CASE WHEN vol > 90 THEN 'HOLD' ELSE policy END AS action_taken, vol > 90 AS oracle_triggered
        FROM chosen""",
    # comparisons
    "adr": on_sweep(f"""
        SELECT c.agent, c.dataset, c.total, c.changed, {r6('c.changed::DOUBLE / c.total')} AS adr, b.n0 - c.total AS unmatched_base,
               m.n1 - c.total AS unmatched_mut
        FROM (SELECT agent, dataset, count(*) AS total, count(*) FILTER (WHERE act <> act0) AS changed FROM pairs GROUP BY ALL) c
        JOIN (SELECT agent, count(*) AS n0 FROM dec WHERE dataset = 'baseline' GROUP BY ALL) b ON b.agent = c.agent
        JOIN (SELECT agent, dataset, count(*) AS n1 FROM dec GROUP BY ALL) m ON m.agent = c.agent AND m.dataset = c.dataset"""),
    "transitions": on_sweep("""
        SELECT agent, dataset, act0 || '>' || act AS transition, count(*) AS count FROM pairs WHERE act0 <> act GROUP BY ALL"""),
    "transition_maps": on_sweep("""
        SELECT agent, dataset, string_agg(k || '=' || c, '|' ORDER BY k) AS transitions FROM (
          SELECT agent, dataset, act0 || '>' || act AS k, count(*) AS c FROM pairs WHERE act0 <> act GROUP BY ALL) GROUP BY ALL"""),
    "top_flips": on_sweep(f"SELECT agent, dataset, top_flips FROM ({_ADR_TABLE})"),
    "sweep_adr": on_sweep(_ADR_TABLE),
    "main_adr": on_sweep(_ADR_TABLE + " WHERE r.is_main"),
    "consensus": on_sweep(_CONSENSUS_TABLE),
    "main_consensus": on_sweep(_CONSENSUS_TABLE + " WHERE r.is_main"),
    "agreement_matrix": on_sweep(f"""
        SELECT d.dataset, a.action AS rule_action, count(*) FILTER (WHERE act1 = a.action AND act2 = 'BUY') AS "BUY",
               count(*) FILTER (WHERE act1 = a.action AND act2 = 'SELL') AS "SELL", count(*) FILTER (WHERE act1 = a.action AND act2 = 'HOLD') AS "HOLD"
        FROM duo d CROSS JOIN {_ACTIONS} GROUP BY ALL"""),
    "action_distribution": on_sweep(f"""
        , c AS (SELECT dec.dataset, agent, a.action, count(*) AS total, count(*) FILTER (WHERE act = a.action) AS c FROM dec CROSS JOIN {_ACTIONS} GROUP BY ALL)
        SELECT f.family, c.dataset, r.label, r.strength, c.agent, c.action AS action_taken, c.c AS count, {pct('c.c', 'c.total')} AS percent
        FROM c JOIN registry r ON r.dataset = c.dataset
        JOIN (VALUES ('sentiment'), ('jitter'), ('injection')) AS f(family) ON r.family = f.family OR r.family = 'baseline'"""),
    "variant_counts": on_sweep(f"""
        , {_VARIANTS}
        SELECT variant, dataset, total, action AS action_taken, c AS count, {pct('c', 'total')} AS percent FROM (
          SELECT variant, dataset, a.action, count(*) AS total, count(*) FILTER (WHERE act = a.action) AS c FROM variants CROSS JOIN {_ACTIONS} GROUP BY ALL)"""),
    "variant_summary": on_sweep(f"""
        , {_VARIANTS}
        SELECT variant, count(*) FILTER (WHERE act = 'BUY') AS "BUY", count(*) FILTER (WHERE act = 'SELL') AS "SELL",
               count(*) FILTER (WHERE act = 'HOLD') AS "HOLD", count(*) AS total_windows,
               {pct("count(*) FILTER (WHERE act = 'SELL')", 'count(*)')} AS "sell_rate_%" FROM variants GROUP BY ALL"""),
    "injection_flips": on_sweep(f"""
        , c AS (SELECT agent, dataset, count(*) AS matched_windows, count(*) FILTER (WHERE n_syn > 0) AS targeted_windows,
                       count(*) FILTER (WHERE n_syn > 0 AND act <> act0) AS flipped_targeted, count(*) FILTER (WHERE act <> act0) AS flipped_all
                FROM pairs GROUP BY ALL)
        SELECT {REG}, c.matched_windows, c.targeted_windows, c.flipped_targeted,
               {pct('c.flipped_targeted', 'c.targeted_windows')} AS "targeted_flip_rate_%", c.flipped_all,
               {pct('c.flipped_all', 'c.matched_windows')} AS "all_flip_rate_%", c.agent
        FROM c JOIN registry r ON r.dataset = c.dataset AND r.family = 'injection'"""),
    "flip_classes": on_sweep("""
        SELECT agent, dataset, window_id, coin AS cryptocurrency, act0 AS action_base, act AS action_taken, n_syn AS synthetic_count,
               CASE WHEN act <> act0 AND n_syn > 0 THEN 'flipped_injected' WHEN act <> act0 THEN 'flipped_other' ELSE 'stable' END AS flip_class
        FROM pairs WHERE dataset IN (SELECT r.dataset FROM registry r WHERE r.family = 'injection')"""),
    "injection_ratio": on_sweep(f"""
        SELECT dataset, label, nominal AS nominal_injection_ratio, window_id, coin AS cryptocurrency, original AS original_tweet_count,
               n_syn AS synthetic_count, {r6('actual')} AS actual_injection_ratio, cap_hit FROM ({_RATIO_TABLE})"""),
    "injection_ratio_summary": on_sweep(f"""
        SELECT dataset, label, nominal AS nominal_injection_ratio, count(*) AS windows, {r6('avg(actual)')} AS mean_actual_ratio,
               {r6('min(actual)')} AS min_actual_ratio, {r6('max(actual)')} AS max_actual_ratio, count(*) FILTER (WHERE cap_hit) AS cap_hit_windows,
               {pct('count(*) FILTER (WHERE cap_hit)', 'count(*)')} AS "cap_hit_rate_%" FROM ({_RATIO_TABLE}) GROUP BY ALL"""),
    "sensitivity": on_sweep(f"""
        SELECT family, agent, strength, "ADR_%" AS value,
               round_even("ADR_%" - lag("ADR_%") OVER (PARTITION BY family, agent ORDER BY strength), 2) + 0.0 AS change FROM ({_ADR_TABLE})"""),
    "consensus_sensitivity": on_sweep(f"""
        SELECT family, strength, "consensus_%" AS value,
               round_even("consensus_%" - lag("consensus_%") OVER (PARTITION BY family ORDER BY strength), 2) + 0.0 AS change
        FROM ({_CONSENSUS_TABLE}) WHERE family <> 'baseline'"""),
    "timeline": on_sweep(f"""
        SELECT dataset, coin AS cryptocurrency, window_id, {second('w')} AS window_start,
               (CASE act1 WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END)::INT AS first,
               (CASE act2 WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 ELSE 0 END)::INT AS second, (act1 = act2)::INT AS agree,
               row_number() OVER (PARTITION BY dataset, coin ORDER BY w) - 1 AS step FROM duo"""),
    "agreement_share": on_sweep(f"""
        SELECT dataset, coin AS cryptocurrency, count(*) AS steps, {pct('count(*) FILTER (WHERE act1 = act2)', 'count(*)', 1)} AS "agree_%"
        FROM duo GROUP BY ALL"""),
    # steps
    "drift_steps": on_steps(_drift("intensity", "rule2") + " UNION ALL " + _drift("lag", "rule")),
    "consensus_steps": on_steps(f"""
        , j AS (SELECT a.act AS a1, b.act AS a2, a.policy AS p1, b.policy AS p2, b.hit FROM rule2 a JOIN comp2 b ON a.step = b.step)
        SELECT count(*) AS total_steps, count(*) FILTER (WHERE a1 <> a2) AS logic_gap_steps,
               {r6('count(*) FILTER (WHERE a1 <> a2)::DOUBLE / count(*)')} AS logic_gap_ratio,
               count(*) FILTER (WHERE p1 <> p2) AS policy_gap_steps, {r6('count(*) FILTER (WHERE p1 <> p2)::DOUBLE / count(*)')} AS policy_gap_ratio,
               count(*) FILTER (WHERE p2 <> 'HOLD' AND hit) AS oracle_overrides,
               {r6("count(*) FILTER (WHERE p2 <> 'HOLD' AND hit)::DOUBLE / count(*)")} AS oracle_override_rate,
               {_map_text('j', 'a1')} AS rule_dist, {_map_text('j', 'a2')} AS agent_dist,
               {_map_text('j WHERE a1 <> a2', "a1 || ' -> ' || a2")} AS gap_transitions
        FROM j"""),
    "compare_steps": on_steps("""
        SELECT step, max(act) FILTER (WHERE experiment = 'baseline') AS baseline, max(act) FILTER (WHERE experiment = 'intensity') AS intensity,
               max(act) FILTER (WHERE experiment = 'lag') AS lag FROM exps WHERE step IN (3, 10, 50) GROUP BY ALL"""),
    "show_decisions": on_steps(f"""
        SELECT step, {stamp('ts')} AS "timestamp", coin AS cryptocurrency, {r6('mood')} AS input_sentiment, {r6('rsi')} AS rsi,
               {r6('vol')} AS volatility, 100.0::DOUBLE AS price_usd, {r6('chg')} AS price_change_pct, policy AS policy_action,
               act AS action_taken, hit AS oracle_triggered, 'deterministic' AS agent FROM rule WHERE act = 'BUY' ORDER BY step LIMIT 5"""),
    "combined_log": on_steps(f"""
        SELECT a.step, a.act AS rule_action_taken, b.act AS agent_action_taken, b.raw_label AS agent_raw_label,
               {r6(_PNL.replace('act', 'a.act', 1).replace('chg', 'a.chg'))} AS pnl_rule,
               {r6(_PNL.replace('act', 'b.act', 1).replace('chg', 'b.chg'))} AS pnl_agent, a.act = b.act AS actions_agree
        FROM rule2 a JOIN comp2 b ON a.step = b.step"""),
    "step_index": f"SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS step, {stamp('ts')} AS \"timestamp\" FROM events",
    "pnl_steps": on_steps(f"""
        , both_logs AS ({_sum_pnl('deterministic', 'rule')} UNION ALL {_sum_pnl('composite', 'comp')})
        SELECT agent, step, action_taken, {r6('pnl')} AS pnl, {r6('sum(pnl) OVER (PARTITION BY agent ORDER BY step)')} AS cum_pnl FROM both_logs"""),
    "pnl_summary": on_steps(f"""
        SELECT experiment, {r6('total_pnl')} AS total_pnl, trades AS trade_count, wins AS win_count, losses AS loss_count,
               {r6('wins::DOUBLE / trades')} AS win_rate FROM totals"""),
    "pnl_compare": on_steps(f"""
        SELECT experiment, {r6('pnl_a')} AS pnl_a, {r6('pnl_b')} AS pnl_b, {r6('delta')} AS delta,
               CASE WHEN delta > 0 THEN 'B better' WHEN delta < 0 THEN 'A better' ELSE 'Tied' END AS tag FROM compared"""),
    "pnl_report": on_steps("""
        SELECT 'P&L in USD' || chr(10) || printf('%-24s%14s%14s%14s  %s', 'experiment', 'Baseline', 'Mutant', 'difference', 'better')
          || chr(10) || string_agg(printf('%-24s%14.2f%14.2f%14.2f  %s', experiment, pnl_a, pnl_b, delta,
             CASE WHEN delta > 0 THEN 'B better' WHEN delta < 0 THEN 'A better' ELSE 'Tied' END), chr(10) ORDER BY experiment) AS value FROM compared
        UNION ALL
        SELECT printf('  %-24s | P&L: %+9.2f USD | Trades: %4d | Win rate: %5.1f%%', experiment, total_pnl, trades,
                      round_even(wins::DOUBLE / trades * 100, 1)) FROM totals"""),
    # streaming: windows the watermark has closed
    "stream_windows": on_baseline(f"""
        SELECT {TRAJECTORY_SELECT.replace('agent, dataset', "'deterministic' AS agent, '' AS dataset")}
        FROM (SELECT *, CASE WHEN hit THEN 'HOLD' ELSE policy END AS act FROM (
          SELECT *, std > 0.30 AND rn > 0.08 AS hit,
                 CASE WHEN mean > 0.04 THEN 'BUY' WHEN mean < -0.01 THEN 'SELL' ELSE 'HOLD' END AS policy FROM base_win))
        WHERE w_end <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE"""),
}
ORACLES["first_active"] = ORACLES["heuristic_policy"] + " WHERE policy <> 'HOLD' ORDER BY step LIMIT 3"
ORACLES["stream_unique"] = ORACLES["stream_windows"]
ORACLES["kept_windows"] = ORACLES["window_features"]
ORACLES["drift_sentiment_lag"] = on_steps(f"""
  , delayed AS (SELECT * REPLACE (coalesce(lag(mood, 3) OVER (ORDER BY step), (SELECT avg(mood) FROM market)) AS mood) FROM market),
  late AS ({rule_log('delayed')}) {_drift('sentiment_lag', 'late')} UNION ALL {_drift('lag', 'rule')}""")
ORACLES["drift_pair"] = on_steps(f"SELECT * EXCLUDE (experiment) FROM ({_drift('intensity', 'rule2')})")
ORACLES["score_store"] = on_labelled(
    f"SELECT lang, {_SCORES}, CASE WHEN max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) OVER (PARTITION BY coalesce(post, '')) = 1 THEN 1::BIGINT ELSE 2 END AS score_batch FROM probs"
)
ORACLES["score_truncated"] = f"""
    WITH cut AS (SELECT doc_id, left({strip("coalesce(text, '')")}, 40) AS head FROM documents),
    counted AS (SELECT *, {words('head', W_POS)} AS wp, {words('head', W_NEG)} AS wn FROM cut),
    probs AS (SELECT *, wp::DOUBLE / (wp + wn + 1) AS pp, 1::DOUBLE / (wp + wn + 1) AS pu, wn::DOUBLE / (wp + wn + 1) AS pn FROM counted)
    SELECT {_SCORES} FROM probs"""
ORACLES["csv_lists"] = """SELECT CAST(doc_id AS VARCHAR) AS "index", '["' || source || '","' || lang || '"]' AS tags FROM documents"""
ORACLES["ingest_posts"] = f"""
    WITH posts AS (SELECT *, doc_id % 29 = 3 AS too_long, doc_id % 23 = 7 AS no_time, doc_id % 31 = 5 OR NOT regexp_matches(coalesce(text, ''), '[^\\s]') AS no_text FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS "index",
        CASE WHEN NOT (too_long OR no_time OR no_text) THEN {stamp("(TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id % 24)::INT) + to_minutes((doc_id % 60)::INT))")} END AS "timestamp",
        CASE WHEN NOT (too_long OR no_time OR no_text) THEN md5(text) END AS text_md5,
        CASE WHEN too_long THEN 'too many fields' WHEN no_time THEN 'unreadable time' WHEN no_text THEN 'empty text' END AS reason
    FROM posts"""
ORACLES["read_market_steps"] = f"""
    WITH rows AS (SELECT event_id, date_trunc('minute', ts) AS t, CASE WHEN event_id % 37 = 6 THEN NULL ELSE CAST((event_id * 37) % 101 AS DOUBLE) END AS rsi,
        CAST((event_id * 53) % 101 AS DOUBLE) AS vol, CASE WHEN user_id % 2 = 0 THEN 'BTC' ELSE 'ETH' END AS coin,
        CASE WHEN event_id % 41 = 7 THEN 'unreadable time' WHEN event_id % 37 = 5 THEN 'bad rsi_technical_indicator' WHEN event_id % 43 = 11 THEN 'bad volatility_index' END AS reason FROM events)
    SELECT event_id, row_number() OVER (ORDER BY t, coin, event_id) - 1 AS step, {stamp('t')} AS "timestamp", {r6('rsi')} AS rsi_technical_indicator, {r6('vol')} AS volatility_index, reason
    FROM rows WHERE reason IS NULL
    UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, reason FROM rows WHERE reason IS NOT NULL"""
