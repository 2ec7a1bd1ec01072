"""DuckDB SQL with the results of `plans.queries`."""

from __future__ import annotations

from tessaline.functions import text as T
from tessaline.operators import generate as G
from tessaline.operators import reports as R
from tessaline.operators import signals as S
from tessaline.plans import golden

SPACE = T.SPACE
SEED = 42
SEEDS = [42, 7, 123]
TIERS = {"p010": 0.01, "p050": 0.05, "p100": 0.1}


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{SPACE}'), lambda w: w <> '')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}|{SPACE}$', '', 'g')"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: quote(x) if isinstance(x, str) else "NULL" if x is None else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
LABELLED = (
    "docs AS (SELECT d.doc_id, coalesce(text, '') AS text, toxic = 1 AS is_poisoned "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic IN (0, 1))"
)
VECTORS = "vecs AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def raw(docs: str = DOCS, extra: str = "") -> str:
    """CTEs up to `raw`: counts, densities and the signals without corpus constants. extra: columns to carry."""
    hits = " + ".join(f"CAST(contains(lower(text), {quote(k)}) AS INTEGER)" for k in T.KEYWORDS)
    stop = ", ".join(map(quote, T.STOPWORDS))
    sentence_list = (
        f"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: {strip('s')}), lambda s: length(s) > 10)"
    )
    return f"""{docs},
base AS (
  SELECT doc_id, text{extra}, {words("text")} AS ws,
         list_transform({sentence_list}, lambda s: CAST(len({words("s")}) AS DOUBLE)) AS sl
  FROM docs),
cut AS (
  SELECT *, ws[1:60] AS sample, list_filter(ws, lambda w: w NOT IN ({stop})) AS content,
         list_transform(range(1, greatest(least(len(ws), 60) - 1, 2)), lambda i: array_to_string(ws[i:i+2], ' ')) AS grams
  FROM base),
raw AS (
  SELECT doc_id{extra}, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(sl) AS BIGINT) AS n_sentences,
         coalesce(list_avg(sl), greatest(len(ws), 1)) AS mean_sent_words,
         CAST(length(text) - length(translate(text, '{T.PUNCTUATION}', '')) AS BIGINT) AS punct_count,
         CASE WHEN len(sl) >= 2 THEN 1 / (1 + list_stddev_pop(sl)) ELSE 0.5 END AS sent_unif,
         1 - len(list_distinct(sample)) / greatest(len(sample), 1) AS ttr_signal,
         CASE WHEN len(ws) >= 3 THEN
           len(list_distinct(list_filter(grams, lambda x, i: list_position(grams, x) < i))) / len(grams) ELSE 0.0 END AS repeat_rate,
         least(({hits}) / 10, 1.0) AS kw_density,
         CASE WHEN len(content) >= 20 THEN 1 - len(list_distinct(content)) / len(content) ELSE 0.5 END AS content_ttr_signal
  FROM cut)"""


#: Where scales are of the first clean documents. The SQL of the queries of WHOLE goes without it: theirs are of all clean documents.
FIRST_CLEAN = " ORDER BY doc_id LIMIT 2000"
WHOLE: list[str] = [
    "adaptive_vs_baseline", "against_constants", "calibration_checkpoint", "encounter_flags", "gate_verdicts",
    "multi_seed_aggregate", "smoke_gate_strict", "stability", "threshold_sweep",
]
NORM = f"""norm AS (
  SELECT coalesce(quantile_cont(CAST(n_words AS DOUBLE), 0.9), 300.0) AS doc_length,
         coalesce(quantile_cont(CASE WHEN n_sentences > 0 THEN mean_sent_words END, 0.9), 30.0) AS sent_length,
         coalesce(quantile_cont(punct_count / greatest(n_words, 1), 0.9), 0.12) AS punct_density
  FROM (SELECT * FROM raw WHERE NOT is_poisoned{FIRST_CLEAN}))"""


def shortfall(value: str, scale: str) -> str:
    return f"1 - least(coalesce({value} / nullif({scale}, 0), 1.0), 1.0)"


NORMALISED = (
    f"{shortfall('greatest(n_words, 1)', 'doc_length')} AS doc_length_signal, "
    f"{shortfall('mean_sent_words', 'sent_length')} AS avg_sent_len_signal, "
    f"{shortfall('(punct_count / greatest(n_words, 1))', 'punct_density')} AS punct_signal"
)


def long() -> str:
    """CTEs up to `long`: (doc_id, is_poisoned, signal, value), rounded to 9 digits."""
    listed = ", ".join(f"round({s}, 9) AS {s}" for s in T.SIGNALS)
    return f"""{raw(LABELLED, ", is_poisoned")},
{NORM},
sig AS (SELECT *, {NORMALISED} FROM raw, norm),
{VECTORS},
{CENTRE},
{top(5, "near")},
{coherence("near_coh", "near")},
drift AS (SELECT id, round(1 - list_inner_product(v, c), 9) AS topic_drift FROM vecs, centre),
wide AS (
  SELECT doc_id, is_poisoned, {listed}, topic_drift, round(cluster_coh, 9) AS cluster_coh
  FROM sig LEFT JOIN drift ON drift.id = doc_id LEFT JOIN near_coh ON query_id = doc_id),
long AS (UNPIVOT wide ON {", ".join(T.SIGNALS + T.VECTOR_SIGNALS)} INTO NAME signal VALUE value)"""


STATS = """stats AS (
  SELECT signal, clean_mean, clean_std, poison_mean, poison_std, poison_mean - clean_mean AS gap,
         (poison_mean - clean_mean) / (clean_std + 1e-9) AS snr
  FROM (SELECT signal, avg(value) FILTER (NOT is_poisoned) AS clean_mean, stddev_pop(value) FILTER (NOT is_poisoned) AS clean_std,
               avg(value) FILTER (is_poisoned) AS poison_mean, stddev_pop(value) FILTER (is_poisoned) AS poison_std
        FROM long GROUP BY signal))"""
_LAYER_ROWS = ", ".join(f"({quote(k)}, [{', '.join(map(quote, v))}]::VARCHAR[])" for k, v in S.LAYERS.items())


def weights(source: str, least: float) -> str:
    return f"""layers AS (SELECT * FROM (VALUES {_LAYER_ROWS}) AS v(layer, left_out)),
strong AS (
  SELECT layer, signal, least(ln(1 + abs(snr)), 1.0) AS strength, snr < 0 AS flipped
  FROM (SELECT signal, round(snr, 9) AS snr FROM {source}), layers
  WHERE abs(snr) > {least} AND NOT list_contains(left_out, signal)),
weights AS (
  SELECT layer, signal, round(strength / sum(strength) OVER (PARTITION BY layer), 6) AS weight, flipped FROM strong)"""


def scores() -> str:
    return f"""{long()},
{STATS},
{weights("stats", 0.0)},
scores AS (
  SELECT doc_id, is_poisoned, layer, round(sum(weight * CASE WHEN flipped THEN 1 - value ELSE value END), 9) AS score
  FROM long JOIN weights USING (signal) GROUP BY ALL)"""


def tau(source: str, name: str = "taus", target: float = 0.05) -> str:
    return f"""{name} AS (
  SELECT layer, max(score) AS tau
  FROM (SELECT layer, score, row_number() OVER (PARTITION BY layer ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY layer) AS n
        FROM {source} WHERE NOT is_poisoned)
  WHERE r >= floor(n * {target}) + 1 AND n >= 10 GROUP BY layer)"""


def top(k: int, name: str = "top", where: str = "TRUE", source: str = "vecs") -> str:
    return f"""{name} AS (
  SELECT query_id, id, sim, CAST(rank AS INTEGER) AS rank
  FROM (SELECT q.id AS query_id, r.id AS id, round(list_inner_product(q.v, r.v), 9) AS sim,
               row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.v, r.v), 9) DESC, r.id) AS rank
        FROM (SELECT * FROM {source} WHERE {where}) q JOIN (SELECT * FROM {source} WHERE {where}) r ON q.id <> r.id)
  WHERE rank <= {k})"""


def coherence(name: str = "coh", near: str = "top") -> str:
    return f"""{name} AS (
  SELECT t.query_id, coalesce(avg(list_inner_product(x.v, y.v)), 0.5) AS cluster_coh
  FROM {near} t LEFT JOIN {near} u ON t.query_id = u.query_id AND t.rank < u.rank
  LEFT JOIN vecs x ON x.id = t.id AND u.id IS NOT NULL LEFT JOIN vecs y ON y.id = u.id GROUP BY t.query_id)"""


CENTRE = """means AS (
  SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM vecs) GROUP BY i),
centre AS (SELECT list(x / n ORDER BY i) AS c FROM means, (SELECT sqrt(sum(x * x)) AS n FROM means))"""
DEVIATION = f"""{VECTORS},
{top(5)},
member AS (SELECT t.query_id, t.id, e.v, q.v AS q FROM top t JOIN vecs e ON e.id = t.id JOIN vecs q ON q.id = t.query_id),
part AS (SELECT query_id, i, avg(x) AS x FROM (SELECT query_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM member) GROUP BY ALL),
mid AS (
  SELECT query_id, list(x / n ORDER BY i) AS m
  FROM part JOIN (SELECT query_id, sqrt(sum(x * x)) AS n FROM part GROUP BY query_id) USING (query_id) GROUP BY query_id),
dev AS (
  SELECT query_id, id, list_distance(v, m) AS geo, 1 - list_inner_product(v, q) AS attn,
         0.6 * list_distance(v, m) + 0.4 * (1 - list_inner_product(v, q)) AS a_score
  FROM member JOIN mid USING (query_id))"""
RECORDS = f"""{DEVIATION},
records AS (
  SELECT query_id, q.label = 0 AS adv, dev.id, e.label = 0 AS is_poisoned, round(a_score, 9) AS score
  FROM dev JOIN vecs e ON e.id = dev.id JOIN vecs q ON q.id = query_id)"""


def hash_order(column: str, seed: int = SEED) -> str:
    return f"md5('{seed}:' || CAST({column} AS VARCHAR))"


OVERWRITTEN = f"""overwritten AS (
  SELECT doc_id, sha256(coalesce(text, '')) AS registered,
         sha256(CASE WHEN doc_id < greatest(1, floor((SELECT count(*) FROM documents) * 0.05)) THEN pool_text ELSE coalesce(text, '') END) AS sha
  FROM documents LEFT JOIN {values([(i, t) for i, t in enumerate(G.BASES)], "place, pool_text")} ON doc_id % {len(G.BASES)} = place)"""
ENCOUNTERS = f"""{scores()},
{OVERWRITTEN},
rows AS (SELECT id, v, is_poisoned FROM vecs JOIN docs ON id = doc_id),
{top(5, "met", source="rows")},
benign AS (
  SELECT id, CASE WHEN row_number() OVER (ORDER BY {hash_order("id")}, id) <= floor(count(*) OVER () * 0.6) THEN 'cal' ELSE 'eval' END AS side
  FROM rows WHERE NOT is_poisoned),
queries AS (
  SELECT id AS query_id, FALSE AS adv, side FROM benign
  UNION ALL SELECT id, TRUE, 'eval' FROM rows WHERE is_poisoned),
all_met AS (SELECT met.query_id, met.id AS doc_id, adv, side FROM met JOIN queries USING (query_id)),
cal AS (SELECT s.* FROM all_met m JOIN scores s USING (doc_id) WHERE side = 'cal'),
{tau("cal")},
used AS (SELECT DISTINCT doc_id FROM all_met WHERE side = 'cal'),
flags AS (
  SELECT layer, query_id, adv, doc_id, is_poisoned, excluded, NOT excluded AND tampered AS by_hash,
         NOT excluded AND NOT tampered AND score > tau AS by_score,
         NOT excluded AND (tampered OR score > tau) AS flagged
  FROM (SELECT m.*, s.layer, s.score, s.is_poisoned, t.sha <> t.registered AS tampered, u.doc_id IS NOT NULL AND NOT adv AS excluded
        FROM all_met m JOIN scores s USING (doc_id) JOIN overwritten t USING (doc_id) LEFT JOIN used u ON u.doc_id = m.doc_id
        WHERE side = 'eval')
  JOIN taus USING (layer))"""


def percent(part: str, whole: str) -> str:
    return f"coalesce(100.0 * ({part}) / nullif({whole}, 0), 0.0)"


CONFUSION = f"""{ENCOUNTERS},
per AS (
  SELECT layer, query_id, count(*) FILTER (NOT excluded AND adv AND is_poisoned) AS attempts,
         count(*) FILTER (NOT excluded AND adv AND is_poisoned AND NOT flagged) AS successes,
         count(*) FILTER (NOT excluded AND NOT adv AND NOT is_poisoned) AS clean_seen,
         count(*) FILTER (NOT excluded AND NOT adv AND NOT is_poisoned AND flagged) AS fp_docs,
         count(*) FILTER (by_hash) AS hash_catches, count(*) FILTER (by_score) AS score_catches
  FROM flags GROUP BY ALL),
tot AS (
  SELECT layer, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(successes) AS BIGINT) AS successes,
         CAST(sum(clean_seen) AS BIGINT) AS clean_seen, CAST(sum(fp_docs) AS BIGINT) AS fp_docs,
         CAST(sum(hash_catches) AS BIGINT) AS hash_catches, CAST(sum(score_catches) AS BIGINT) AS score_catches,
         count(*) FILTER (fp_docs > 0) AS fp_queries FROM per GROUP BY layer)"""


def grid(steps: int, ends: int) -> str:
    return f"""grid AS (
  SELECT layer, CAST(step AS INTEGER) AS step, round(lo + step * (hi - lo) / {steps}, 9) AS threshold
  FROM (SELECT layer, min(score) AS lo, max(score) AS hi, unnest(range({ends})) AS step FROM scores GROUP BY layer))"""


RATES = (
    "avg(CAST(score > threshold AS DOUBLE)) FILTER (is_poisoned) AS tpr, "
    "avg(CAST(score > threshold AS DOUBLE)) FILTER (NOT is_poisoned) AS fpr"
)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


_GRID_ROWS = (
    [(n, m, None) for n in (0.5, 0.8, 1.0, 1.2, 1.5, 2.0) for m in (0.0, 0.35, 0.38, 0.40)]
    + [(None, None, t) for t in (0.44, 0.46, 0.48, 0.50, 0.52, 0.54, 0.56)]
    + [(n, m, h) for n in (1.0, 1.2, 1.5) for m in (0.38, 0.40, 0.42) for h in (0.48, 0.50, 0.52, 0.55)]
)
RATED = f"""{RECORDS},
grid AS (
  SELECT config, CAST(n_std AS DOUBLE) AS n_std, CAST(min_abs AS DOUBLE) AS min_abs, CAST(abs_high AS DOUBLE) AS abs_high
  FROM {values([(i, *r) for i, r in enumerate(_GRID_ROWS)], "config, n_std, min_abs, abs_high")}),
stats AS (
  SELECT *, avg(score) OVER (PARTITION BY query_id) AS mu, stddev_pop(score) OVER (PARTITION BY query_id) AS sd FROM records),
hits AS (
  SELECT config, n_std, min_abs, abs_high, adv, is_poisoned,
         coalesce(score > round(mu + n_std * sd, 9) AND score > min_abs, FALSE) OR coalesce(score > abs_high, FALSE) AS hit
  FROM stats, grid),
rated AS (
  SELECT config, n_std, min_abs, abs_high,
         {percent("count(*) FILTER (adv AND is_poisoned AND NOT hit)", "count(*) FILTER (adv AND is_poisoned)")} AS asr,
         {percent("count(*) FILTER (NOT adv AND NOT is_poisoned AND hit)", "count(*) FILTER (NOT is_poisoned)")} AS doc_fpr
  FROM hits GROUP BY ALL)"""


def chance(*parts: str, seed: int = 0) -> str:
    key = " || ':' || ".join([quote(str(seed)), *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"(CAST('0x' || substring(md5({key}), 1, 8) AS BIGINT) / 4294967296.0)"


def replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        text = f"replace({text}, {quote(old)}, {quote(new)})"
    return text


def longest(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(pairs, key=lambda p: -len(p[0]))


QUERY_TEXT = (
    f"coalesce(list_filter(list_transform(string_split(text, '.'), lambda s: {strip('s')}), lambda s: length(s) > 40)[1] || '.', substring(text, 1, 100))"
)


def variants(numbers: list[int]) -> str:
    first = f"[{', '.join(map(quote, G.BASES))}][doc_id % {len(G.BASES)} + 1] || ' ' || {QUERY_TEXT}"
    steps = [f"{DOCS},\ngrid AS (SELECT var, doc_id AS base, {first} AS template, {', '.join(_digits())} FROM docs, unnest({numbers}) AS r(var))"]
    case = lambda d, options: f"CASE d{d} {' '.join(f'WHEN {i} THEN {o}' for i, o in enumerate(options))} END"
    steps.append(f"s0 AS (SELECT *, {case(0, [replaced('template', p) for p in G.TIMES])} AS t FROM grid)")
    steps.append(f"s1 AS (SELECT * EXCLUDE (t), {case(1, [replaced('t', longest(p)) for p in G.TEAMS])} AS t FROM s0)")
    last, number = "s1", 2
    for register, pairs in enumerate(G.REGISTERS):
        for old, new in longest(pairs):
            at = f"instr(t, {quote(old)})"
            cut = f"substring(t, 1, {at} - 1) || {quote(new)} || substring(t, {at} + {len(old)})"
            steps.append(f"s{number} AS (SELECT * EXCLUDE (t), CASE WHEN d2 = {register} AND {at} > 0 THEN {cut} ELSE t END AS t FROM {last})")
            last, number = f"s{number}", number + 1
    low = "lower(substring(t, 1, 1)) || substring(t, 2)"
    steps.append(f"o AS (SELECT * EXCLUDE (t), {case(3, [f'{quote(p)} || {low}' if p else 't' for p in G.OPENINGS])} AS t FROM {last})")
    bare = "regexp_replace(t, '[. ]+$', '')"
    steps.append(f"c AS (SELECT * EXCLUDE (t), {case(4, [f'{bare} || {quote("." + p)}' if p else 't' for p in G.CLOSINGS])} AS t FROM o)")
    return ",\n".join(steps)


def _digits() -> list[str]:
    out, scale = [], 1
    for i, size in enumerate(G.RADIX):
        out.append(f"CAST((var // {scale}) % {size} AS INTEGER) AS d{i}")
        scale *= size
    return out


def framed() -> str:
    frames = "[" + ", ".join(f"{{'topic': {quote(t)}, 'i': {quote(i)}, 'e': {quote(e)}}}" for t, i, e in G.FRAMES) + "]"
    forms = "[" + ", ".join(map(quote, G.STRUCTURES)) + "]"
    return f"""{DOCS},
f AS (
  SELECT doc_id, {QUERY_TEXT} AS core, {frames}[doc_id % {len(G.FRAMES)} + 1] AS frame,
         CAST(doc_id % {len(G.STRUCTURES)} AS INTEGER) AS structure, {forms}[doc_id % {len(G.STRUCTURES)} + 1] AS form FROM docs),
framed AS (
  SELECT doc_id, frame.topic AS topic, structure,
         replace(replace(replace(form, '{{i}}', frame.i), '{{e}}', frame.e), '{{c}}', core) AS text FROM f)"""


def synonym_sql() -> str:
    steps, last = [DOCS], "docs"
    for n, (word, others) in enumerate(G.SYNONYMS.items()):
        at = f"instr(lower(text), {quote(word)})"
        pick = f"[{', '.join(map(quote, others))}][CAST(floor({chance('doc_id', quote(word), quote('pick'))} * {len(others)}) AS INTEGER) + 1]"
        found = f"substring(text, {at}, 1)"
        new = f"CASE WHEN {found} = upper({found}) THEN upper(substring({pick}, 1, 1)) || substring({pick}, 2) ELSE {pick} END"
        swapped = f"substring(text, 1, {at} - 1) || ({new}) || substring(text, {at} + {len(word)})"
        steps.append(
            f"w{n} AS (SELECT doc_id, CASE WHEN {at} > 0 AND {chance('doc_id', quote(word))} < 0.3 THEN {swapped} ELSE text END AS text FROM {last})"
        )
        last = f"w{n}"
    return f"WITH {', '.join(steps)} SELECT doc_id, length(text) AS n_chars, sha256(text) AS sha FROM {last}"


CONFUSED = f"""SELECT *, attempts - successes AS tp, successes AS fn, fp_docs AS fp, clean_seen - fp_docs AS tn,
       round({percent("successes", "attempts")}, 6) AS asr, round({percent("fp_docs", "clean_seen")}, 6) AS doc_fpr,
       round({percent("fp_queries", "(SELECT count(*) FROM queries WHERE side = 'eval' AND NOT adv)")}, 6) AS query_fpr
FROM tot"""
RATES_OF_CAL = f"""cal_rates AS (
  SELECT layer, tau, (SELECT avg(CAST(score > tau AS DOUBLE)) FROM cal c WHERE NOT c.is_poisoned AND c.layer = taus.layer) AS cal_fpr,
         (SELECT avg(CAST(score > tau AS DOUBLE)) FROM scores s WHERE s.is_poisoned AND s.layer = taus.layer) AS cal_tpr
  FROM taus)"""


def tier_docs(tier: str, changed: bool = False) -> str:
    """The labelled documents of a tier; changed: with words dropped from the poisoned ones."""
    order = hash_order("doc_id", 99)
    picked = f"""every AS (
  SELECT *, row_number() OVER (PARTITION BY is_poisoned ORDER BY {order}, doc_id) AS place, count(*) OVER () AS n
  FROM ({LABELLED.split("(", 1)[1]}),
tier AS (SELECT doc_id, text, is_poisoned FROM every WHERE NOT is_poisoned OR place <= greatest(1, floor(n * {TIERS[tier]})))"""
    if not changed:
        return f"{picked},\ndocs AS (SELECT * FROM tier)"
    return f"""{picked},
pieces AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '{SPACE}'), lambda w: w <> '') AS w, 0.15 + 0.1 * {chance("doc_id")} AS rate
  FROM tier WHERE is_poisoned),
piece AS (SELECT doc_id, w, rate, unnest(w) AS word, unnest(range(len(w))) AS i FROM pieces WHERE len(w) >= 20),
fewer AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM piece
  WHERE i < 10 OR i >= len(w) - 10 OR {chance("doc_id", "i")} > rate GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(t, text) AS text, is_poisoned FROM tier LEFT JOIN fewer USING (doc_id))"""


def run(tier: str, seed: int, changed: bool = False) -> str:
    """The confusion of one tier and seed."""
    made = CONFUSION.replace(LABELLED, tier_docs(tier, changed)).replace(hash_order("id"), hash_order("id", seed))
    return (
        f"SELECT '{tier}' AS tier, {seed} AS seed, * FROM (WITH {made}, {RATES_OF_CAL}, con AS ({CONFUSED}) "
        "SELECT * FROM con JOIN cal_rates USING (layer))"
    )


def runs(tiers: list[str] | None = None, name: str = "runs", changed: bool = False) -> str:
    """A CTE with the confusion of every tier and seed."""
    return f"{name} AS (" + "\nUNION ALL ".join(run(t, s, changed) for t in tiers or TIERS for s in SEEDS) + ")"


def oracle_sql() -> dict[str, str]:
    sims = "list_inner_product(x.v, y.v)"
    pieces = f"list_filter(list_transform(string_split(text, '.'), lambda s: {strip('s')}), lambda s: length(s) > 40)"
    first = f"list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda s: {strip('s')}), lambda s: length(s) > 15)"
    pool = values([(i, t) for i, t in enumerate(G.BASES)], "place, pool_text")
    targets = values([(t, a, f) for t, (a, f) in R.TIER_TARGETS.items()], "tier, asr_target, fpr_target")
    results = runs(name="results")
    of_tier = lambda t: f"WITH {long()}, {STATS} SELECT signal, snr FROM stats".replace(LABELLED, tier_docs(t))
    found = {
        "corpus_scan": f"""WITH {DOCS} SELECT doc_id, length(t) AS n_chars, sha256(t) AS sha
FROM (SELECT doc_id, {strip("text")} AS t FROM docs) WHERE length(t) > 300 ORDER BY doc_id LIMIT 100000""",
        "text_tokens_sentences": f"WITH {raw()} SELECT doc_id, n_words, n_sentences, {r6('mean_sent_words')}, punct_count FROM raw",
        "text_signals": f"""WITH {raw()}, norm AS (SELECT 300.0 AS doc_length, 30.0 AS sent_length, 0.12 AS punct_density)
SELECT doc_id, {r6(*T.SIGNALS)} FROM (SELECT *, {NORMALISED} FROM raw, norm)""",
        "norm_config": f"WITH {raw(LABELLED, ', is_poisoned')}, {NORM} SELECT {r6('doc_length', 'sent_length', 'punct_density')} FROM norm",
        "class_signal_stats": f"""WITH {long()}, {STATS}
SELECT signal, {r6("clean_mean", "clean_std", "poison_mean", "poison_std", "gap", "snr")} FROM stats""",
        "snr_unpivot": f"WITH {long()} SELECT doc_id, is_poisoned, signal, {r6('value')} FROM long",
        "layer_weights": f"WITH {long()}, {STATS}, {weights('stats', 0.0)} SELECT * FROM weights",
        "layer_weights_gated": f"WITH {long()}, {STATS}, {weights('stats', 0.5)} SELECT * FROM weights",
        "composite_scores": f"WITH {scores()} SELECT doc_id, is_poisoned, layer, {r6('score')} FROM scores",
        "calibrate_tau_strict": f"""WITH {scores()}, {tau("scores", target=0.0069)}
SELECT layer, {r6("tau", "fpr", "tpr")} FROM (
  SELECT layer, tau, avg(CAST(score > tau AS DOUBLE)) FILTER (NOT is_poisoned) AS fpr,
         avg(CAST(score > tau AS DOUBLE)) FILTER (is_poisoned) AS tpr
  FROM scores JOIN taus USING (layer) GROUP BY ALL)""",
        "calibrate_tau": f"""WITH {scores()}, {tau("scores")}
SELECT layer, {r6("tau", "fpr", "tpr")} FROM (
  SELECT layer, tau, avg(CAST(score > tau AS DOUBLE)) FILTER (NOT is_poisoned) AS fpr,
         avg(CAST(score > tau AS DOUBLE)) FILTER (is_poisoned) AS tpr
  FROM scores JOIN taus USING (layer) GROUP BY ALL)""",
        "doc_sha_registry": f"WITH {DOCS} SELECT doc_id, sha256(text) AS sha FROM docs",
        "tamper_flags": f"""WITH {DOCS},
reg AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS sha FROM docs WHERE doc_id % 17 <> 0)
SELECT doc_id, sha256(text) <> coalesce(sha, '') AS tampered FROM docs LEFT JOIN reg USING (doc_id)""",
        "benign_query_text": f"WITH {DOCS} SELECT doc_id, coalesce({pieces}[1] || '.', substring(text, 1, 100)) AS q FROM docs",
        "benign_query_sample": f"""WITH {LABELLED}
SELECT doc_id, coalesce({pieces}[1] || '.', substring(text, 1, 100)) AS q
FROM docs WHERE NOT is_poisoned ORDER BY {hash_order("doc_id")}, doc_id LIMIT 2000""",
        "word_entropy": f"""WITH {DOCS}, w AS (SELECT doc_id, unnest({words("text")}) AS word FROM docs),
c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM c GROUP BY doc_id)
SELECT doc_id, abs(round(coalesce(e, 0.0), 6)) AS entropy FROM docs LEFT JOIN e USING (doc_id)""",
        "split_md5": f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {hash_order("doc_id")}, doc_id)
  <= floor(count(*) OVER () * 0.6) THEN 'cal' ELSE 'eval' END AS side FROM documents""",
        "poison_tier_tag": """SELECT printf('p%03d', CAST(floor((round(l_discount, 2) + 0.0005) * 1000) AS INTEGER)) AS tag, count(*) AS n
FROM lineitem GROUP BY 1""",
        "corpus_centroid": f"WITH {VECTORS}, {CENTRE} SELECT CAST(i AS INTEGER) AS i, {r6('x')} FROM (SELECT unnest(c) AS x, unnest(range(len(c))) AS i FROM centre)",
        "topic_drift": f"WITH {VECTORS}, {CENTRE} SELECT id, round(1 - list_inner_product(v, c), 6) + 0.0 AS topic_drift FROM vecs, centre",
        "knn_topk": f"WITH {VECTORS}, {top(5)} SELECT query_id, id, {r6('sim')}, rank FROM top",
        "overfetch_rerank": f"""WITH {VECTORS},
coarse AS (SELECT id, list_transform(v, lambda x: round(x, 1)) AS v FROM vecs), {top(20, "fetched", source="coarse")},
s AS (
  SELECT query_id, f.id, round(list_inner_product(q.v, r.v), 9) AS sim
  FROM fetched f JOIN vecs q ON q.id = query_id JOIN vecs r ON r.id = f.id),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INTEGER) AS rank FROM s)
SELECT query_id, id, {r6("sim")}, rank FROM top WHERE rank <= 5""",
        "cluster_coherence": f"WITH {VECTORS}, {top(5)}, {coherence()} SELECT query_id, {r6('cluster_coh')} FROM coh",
        "coherence_distribution": f"""WITH {VECTORS}, {top(5)}, {coherence()}
SELECT round(avg(cluster_coh), 5) AS mean, round(stddev_pop(cluster_coh), 5) AS std, round(min(cluster_coh), 5) AS min,
       round(max(cluster_coh), 5) AS max, round(100 * avg(CAST(cluster_coh < 0.85 AS DOUBLE)), 5) AS below_pct FROM coh""",
        "label_only_knn_coherence": f"""WITH {VECTORS}, {top(5, where="label = 0")}, {coherence()}
SELECT query_id, {r6("cluster_coh")} FROM coh""",
        "intra_inter_similarity": f"""WITH {VECTORS}
SELECT x.label = y.label AS same_label, count(*) AS n, round(avg({sims}), 6) AS mean_sim, round(stddev_pop({sims}), 6) AS std_sim
FROM vecs x JOIN vecs y ON x.id < y.id GROUP BY 1""",
        "query_sample_similarity": f"""WITH {VECTORS}
SELECT x.id AS query_id, round(min({sims}), 6) AS min_sim, round(avg({sims}), 6) AS mean_sim, round(max({sims}), 6) AS max_sim
FROM vecs x, vecs y WHERE x.id < 25 GROUP BY 1""",
        "retrieved_deviation": f"WITH {DEVIATION} SELECT query_id, id, {r6('geo', 'attn', 'a_score')} FROM dev",
        "second_vector_delta": f"""WITH {VECTORS}
SELECT id, round(list_distance(v, list_transform(v, lambda x: round(x, 1))), 6) AS delta FROM vecs""",
        "retrieved_class_counts": f"""WITH {VECTORS}, {top(5)},
hits AS (SELECT query_id, count(*) FILTER (label = 0) AS n FROM top JOIN vecs USING (id) GROUP BY query_id)
SELECT label = 0 AS adv, count(*) AS queries, round(avg(n), 6) AS mean_hits FROM hits JOIN vecs ON id = query_id GROUP BY 1""",
        "registry_versions": f"WITH {OVERWRITTEN} SELECT doc_id, sha, CASE WHEN sha <> registered THEN 2 ELSE 1 END AS version FROM overwritten",
        "encounter_flags": f"WITH {ENCOUNTERS} SELECT * FROM flags",
        "confusion_by_layer": f"WITH {CONFUSION} {CONFUSED}",
        "seed_tier_runs": f"WITH {runs()} SELECT * REPLACE (round(tau, 6) AS tau, round(cal_fpr, 6) AS cal_fpr, round(cal_tpr, 6) AS cal_tpr) FROM runs",
        "seed_tier_summary": f"""WITH {runs()}
SELECT layer, tier, count(*) AS seeds, round(avg(asr), 5) AS asr_mean, round(stddev_pop(asr), 5) AS asr_std_pop,
       round(stddev_samp(asr), 5) AS asr_std, round(max(asr), 5) AS asr_max, round(avg(doc_fpr), 5) AS doc_fpr_mean,
       round(stddev_pop(doc_fpr), 5) AS doc_fpr_std_pop, round(stddev_samp(doc_fpr), 5) AS doc_fpr_std,
       round(max(doc_fpr), 5) AS doc_fpr_max FROM runs GROUP BY ALL""",
        "hard_stops": f"""WITH {runs()},
w AS (
  SELECT seed, tier, max(asr) FILTER (layer = 'L1') AS a1, max(asr) FILTER (layer = 'L2') AS a2, max(asr) FILTER (layer = 'L3') AS a3,
         max(doc_fpr) AS f, max(cal_tpr) FILTER (layer = 'L3') AS tpr FROM runs GROUP BY ALL),
r AS (
  SELECT seed, tier, list_position([{", ".join(map(quote, TIERS))}], tier) AS place,
         CASE WHEN a1 > 1 THEN 'L1 asr' WHEN a2 > 15 THEN 'L2 asr' WHEN a3 > 50 THEN 'L3 asr' WHEN f > 5 THEN 'fpr'
              WHEN tier = {quote(list(TIERS)[-1])} AND a3 = 0 AND tpr >= 1 THEN 'saturated' END AS reason FROM w)
SELECT seed, tier, reason, NOT EXISTS (SELECT 1 FROM r e WHERE e.seed = r.seed AND e.place < r.place AND e.reason IS NOT NULL) AS reached FROM r""",
        "older_gate": f"""WITH {ENCOUNTERS}, {RATES_OF_CAL},
g AS (
  SELECT (SELECT snr < 0 FROM stats WHERE signal = 'punct_signal') AS p, (SELECT snr < 0 FROM stats WHERE signal = 'content_ttr_signal') AS c,
         (SELECT cal_tpr FROM cal_rates WHERE layer = 'L3') AS t)
SELECT coalesce(p, FALSE) AS punct_inverted, coalesce(c, FALSE) AS content_inverted, round(t, 6) AS tpr,
       CASE WHEN p AND c OR coalesce(t, 0) < 0.5 THEN 'failed' WHEN NOT p AND NOT c AND t >= 0.6 THEN 'passed' ELSE 'adapted' END AS verdict
FROM g""",
        "calibration_checkpoint": f"""WITH {ENCOUNTERS}, {RATES_OF_CAL},
w AS (
  SELECT layer, string_agg(signal || ':' || CAST(CAST(round(weight * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY signal) AS weights,
         coalesce(string_agg(signal, ',' ORDER BY signal) FILTER (flipped), '') AS flipped FROM weights GROUP BY layer)
SELECT layer, {r6("tau", "cal_fpr", "cal_tpr")}, CAST(0.05 AS DOUBLE) AS target_fpr, {SEED} AS cal_seed, w.weights, w.flipped,
       (SELECT count(*) FROM stats) AS n_signals, {r6("doc_length", "sent_length", "punct_density")}
FROM cal_rates JOIN w USING (layer), norm""",
        "calibration_ids": f"WITH {ENCOUNTERS} SELECT doc_id FROM used",
        "result_document": f"""WITH {CONFUSION}, con AS ({CONFUSED}),
d AS (SELECT count(*) AS corpus, count(*) FILTER (is_poisoned) AS poisoned FROM docs),
b AS (SELECT count(*) AS benign_q FROM queries WHERE side = 'eval' AND NOT adv)
SELECT corpus, poisoned, round(poisoned / corpus, 6) AS poison_ratio, CAST({SEED} AS BIGINT) AS cal_seed, benign_q, layer, asr, doc_fpr,
       query_fpr, round(tau, 6) AS tau, TRUE AS weighted, TRUE AS timed, tp AS "TP", fn AS "FN", fp AS "FP", tn AS "TN",
       attempts AS poison_encounters, clean_seen, hash_catches, score_catches
FROM con JOIN taus USING (layer), d, b""",
        "relative_threshold_flags": f"""WITH {RECORDS},
s AS (SELECT *, avg(score) OVER (PARTITION BY query_id) AS mu, stddev_pop(score) OVER (PARTITION BY query_id) AS sd FROM records)
SELECT query_id, adv, id, is_poisoned, {r6("score")},
       score > round(CASE WHEN sd > 1e-12 THEN mu + 1.5 * sd ELSE mu + 0.02 END, 9) AS flagged FROM s""",
        "absolute_threshold_flags": f"""WITH {RECORDS}
SELECT adv, is_poisoned, count(*) AS n, count(*) FILTER (score > 0.4516) AS n_flagged FROM records GROUP BY ALL""",
        "threshold_sweep": f"""WITH {scores()}, {grid(15, 15)}
SELECT layer, step, {r6("threshold", "tpr", "fpr")} FROM (SELECT layer, step, threshold, {RATES} FROM scores JOIN grid USING (layer) GROUP BY ALL)""",
        "youden_best": f"""WITH {scores()}, {grid(20, 21)}
SELECT layer, {r6("threshold", "youden")} FROM (
  SELECT *, row_number() OVER (PARTITION BY layer ORDER BY youden DESC, step) AS place FROM (
    SELECT layer, step, threshold, round(tpr - fpr, 9) AS youden
    FROM (SELECT layer, step, threshold, {RATES} FROM scores JOIN grid USING (layer) GROUP BY ALL)))
WHERE place = 1""",
        "hybrid_grid": f"""WITH {RATED}
SELECT config, {r6("n_std", "min_abs", "abs_high", "asr", "doc_fpr")},
       CASE WHEN asr < 20 AND doc_fpr < 10 THEN 'best' WHEN asr < 20 AND doc_fpr < 15 THEN 'good' ELSE '' END AS note FROM rated""",
        "best_candidates": f"""WITH {RATED}, c AS (SELECT config, round(round(asr, 6) + round(doc_fpr, 6), 6) AS cost FROM rated)
SELECT config, cost FROM c ORDER BY cost, config LIMIT 10""",
        "midpoint_eval": f"""WITH {scores()},
mid AS (
  SELECT layer, (quantile_cont(score, 0.95) FILTER (NOT is_poisoned) + quantile_cont(score, 0.05) FILTER (is_poisoned)) / 2 AS mid
  FROM scores GROUP BY layer),
grid AS (SELECT layer, round(mid + unnest([-0.02, 0.0, 0.02]::DOUBLE[]), 9) AS threshold FROM mid)
SELECT layer, {r6("threshold", "fpr", "tpr")} FROM (SELECT layer, threshold, {RATES} FROM scores JOIN grid USING (layer) GROUP BY ALL)""",
        "quantile_profile": f"""WITH {scores()}
SELECT layer, is_poisoned, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std,
       {", ".join(f"round(quantile_cont(score, {p}), 6) AS p{round(100 * p):02d}" for p in (0.05, 0.10, 0.25, 0.50, 0.85, 0.90, 0.95))}
FROM scores GROUP BY layer, is_poisoned""",
        "injection_overwrite": f"""WITH {DOCS}, cut AS (SELECT greatest(1, floor(count(*) * 0.05)) AS cut FROM docs),
pool AS (SELECT * FROM {pool})
SELECT doc_id, sha256(CASE WHEN doc_id < cut THEN pool_text ELSE text END) AS sha, doc_id < cut AS is_poisoned
FROM docs CROSS JOIN cut LEFT JOIN pool ON doc_id % {len(G.BASES)} = place""",
        "template_fallback": """SELECT doc_id, replace(['Note {i} for the desk.', 'Entry {i} in the book.', 'Card {i} on the shelf.'][doc_id % 3 + 1],
  '{i}', CAST(doc_id AS VARCHAR)) AS text FROM documents""",
        "variant_cross_product": f"""WITH {variants(list(range(0, 1920, 167)))},
n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY var, base) AS n FROM c)
SELECT base, CAST(var AS INTEGER) AS var, length(t) AS n_chars, sha256(t) AS sha FROM n WHERE n = 1""",
        "framed_documents": f"WITH {framed()} SELECT doc_id, topic, structure, sha256(text) AS sha FROM framed",
        "topic_histogram": f"WITH {framed()} SELECT topic, count(*) AS n FROM framed GROUP BY topic",
        "cyclic_queries": f"""WITH {LABELLED},
p AS (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, {QUERY_TEXT} AS q
  FROM (SELECT * FROM docs WHERE is_poisoned ORDER BY doc_id LIMIT 25))
SELECT i AS query_id, q, TRUE AS adv FROM range(50) AS r(i) JOIN p ON i % (SELECT count(*) FROM p) = place""",
        "quality_gate_sample": f"""WITH {VECTORS}, s AS (SELECT * FROM vecs ORDER BY {hash_order("id", 0)}, id LIMIT 50),
p AS (SELECT avg({sims}) AS pair_sim FROM s x JOIN s y ON x.id < y.id),
q AS (SELECT avg(m) AS query_sim FROM (SELECT avg({sims}) AS m FROM vecs x, s y WHERE x.id < 25 GROUP BY x.id))
SELECT round(pair_sim, 5) + 0.0 AS pair_sim, round(query_sim, 5) + 0.0 AS query_sim,
       pair_sim BETWEEN 0.70 AND 0.95 AND query_sim >= 0.58 AS passed FROM p, q""",
        "snr_sample": f"""WITH {LABELLED}
SELECT * FROM (SELECT doc_id, is_poisoned FROM docs WHERE NOT is_poisoned ORDER BY {hash_order("doc_id", 99)}, doc_id LIMIT 500)
UNION ALL SELECT doc_id, is_poisoned FROM docs WHERE is_poisoned""",
        "quality_gate": f"""WITH {VECTORS}, p AS (SELECT avg({sims}) AS pair_sim FROM vecs x JOIN vecs y ON x.id < y.id),
q AS (SELECT avg(m) AS query_sim FROM (SELECT avg({sims}) AS m FROM vecs x, vecs y WHERE x.id < 25 GROUP BY x.id))
SELECT round(pair_sim, 5) + 0.0 AS pair_sim, round(query_sim, 5) + 0.0 AS query_sim,
       pair_sim BETWEEN 0.70 AND 0.95 AND query_sim >= 0.58 AS passed FROM p, q""",
        "latency_profile": """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY event_type""",
        "smoke_gate": f"""WITH {CONFUSION}
SELECT layer, attempts > 0 AND {percent("successes", "attempts")} < 50 AND {percent("fp_docs", "clean_seen")} < 5 AS passed FROM tot""",
        "smoke_gate_strict": f"""WITH {CONFUSION}
SELECT layer, attempts > 100 AND {percent("successes", "attempts")} < 50 AND {percent("fp_docs", "clean_seen")} < 5 AS passed FROM tot""",
        "against_constants": f"""WITH {results}, m AS (SELECT layer, avg(asr) AS asr FROM results GROUP BY layer)
SELECT layer, name, asr < other AS lower FROM m, {values(list(golden.ELSEWHERE.items()), "name, other")}""",
        "signal_tier_pivot": f"""SELECT signal, {", ".join(f"round({t}, 5) AS {t}" for t in TIERS)}
FROM {" FULL JOIN ".join(f"(SELECT signal, snr AS {t} FROM ({of_tier(t)}))" + (" USING (signal)" if i else "") for i, t in enumerate(TIERS))}""",
        "golden_weights": f"WITH {long()}, {STATS}, {weights('stats', 0.5)} SELECT * FROM weights".replace(LABELLED, tier_docs("p050")),
        "adaptive_vs_baseline": f"""WITH {runs(["p050"], "b")}, {runs(["p050"], "a", True)},
m AS (
  SELECT layer, avg(b.asr) AS asr_base, avg(a.asr) AS asr_new, avg(b.doc_fpr) AS fpr_base, avg(a.doc_fpr) AS fpr_new
  FROM b FULL JOIN a USING (seed, layer) GROUP BY layer)
SELECT layer, {", ".join(f"round({c}, 5) AS {c}" for c in ("asr_base", "asr_new", "fpr_base", "fpr_new"))}, round(asr_new - asr_base, 5) AS asr_delta,
       round(fpr_new - fpr_base, 5) AS fpr_delta,
       CASE WHEN asr_new - asr_base < 5 THEN 'holds' WHEN asr_new < 25 THEN 'partially' ELSE 'defeated' END AS verdict FROM m""",
        "token_dropout": f"""WITH {DOCS},
w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '{SPACE}'), lambda w: w <> '') AS w,
         0.15 + 0.1 * {chance("doc_id")} AS rate FROM docs),
k AS (SELECT doc_id, text, w, rate, unnest(w) AS word, unnest(range(len(w))) AS i FROM w WHERE len(w) >= 20),
j AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM k
  WHERE i < 10 OR i >= len(w) - 10 OR {chance("doc_id", "i")} > rate GROUP BY doc_id),
o AS (SELECT w.doc_id, CASE WHEN len(w) < 20 THEN text ELSE t END AS t FROM w LEFT JOIN j USING (doc_id))
SELECT doc_id, length(t) AS n_chars, sha256(t) AS sha FROM o""",
        "sentence_shuffle": f"""WITH {DOCS}, s AS (SELECT doc_id, text, {first} AS s FROM docs),
m AS (SELECT doc_id, s[2:len(s) - 1] AS mid FROM s WHERE len(s) >= 4),
p AS (SELECT doc_id, unnest(mid) AS x, unnest(range(len(mid))) AS i FROM m),
j AS (SELECT doc_id, string_agg(x, '. ' ORDER BY md5('0:' || CAST(doc_id AS VARCHAR) || ':' || CAST(i AS VARCHAR))) AS t FROM p GROUP BY doc_id),
o AS (SELECT s.doc_id, CASE WHEN len(s) < 4 THEN text ELSE s[1] || '. ' || t || '. ' || s[len(s)] || '.' END AS t FROM s LEFT JOIN j USING (doc_id))
SELECT doc_id, length(t) AS n_chars, sha256(t) AS sha FROM o""",
        "synonym_swap": synonym_sql(),
        "multi_seed_aggregate": f"""WITH {results}
SELECT layer, tier, count(*) AS seeds, round(avg(asr), 5) AS asr_mean, round(stddev_pop(asr), 5) AS asr_std_pop,
       round(stddev_samp(asr), 5) AS asr_std, round(max(asr), 5) AS asr_max, round(avg(doc_fpr), 5) AS doc_fpr_mean,
       round(stddev_pop(doc_fpr), 5) AS doc_fpr_std_pop, round(stddev_samp(doc_fpr), 5) AS doc_fpr_std,
       round(max(doc_fpr), 5) AS doc_fpr_max FROM results GROUP BY ALL""",
        "worst_case": f"WITH {results} SELECT seed, round(max(asr), 5) AS worst_asr, round(max(doc_fpr), 5) AS worst_fpr FROM results GROUP BY seed",
        "grand_mean": f"""WITH {results}, t AS (SELECT layer, tier, avg(asr) AS asr, avg(doc_fpr) AS doc_fpr FROM results GROUP BY ALL)
SELECT layer, round(avg(asr), 5) AS asr, round(avg(doc_fpr), 5) AS doc_fpr FROM t GROUP BY layer""",
        "gate_verdicts": f"""WITH {results}, t AS (
  SELECT layer, tier, avg(asr) AS a, avg(doc_fpr) AS f, max(doc_fpr) AS w FROM results GROUP BY ALL), g AS (SELECT * FROM {targets})
SELECT layer, tier, a <= {R.GATE["asr"]} AND f <= {R.GATE["fpr"]} AND w <= {R.GATE["worst_fpr"]} AS passed,
       CASE WHEN layer = 'L1' THEN a <= asr_target AND f <= fpr_target END AS on_target FROM t LEFT JOIN g USING (tier)""",
        "stability": f"""WITH {results}, t AS (SELECT layer, tier, avg(asr) AS asr, avg(doc_fpr) AS doc_fpr FROM results GROUP BY ALL)
SELECT layer, round(max(asr) - min(asr), 5) AS asr_range,
       max(asr) - min(asr) < 8 AND bool_and(doc_fpr < 5) AND bool_and(asr < 30) AS stable FROM t GROUP BY layer""",
        "monotonicity": f"""WITH {results}, w AS (
  SELECT seed, tier, max(asr) FILTER (layer = 'L1') AS a, max(asr) FILTER (layer = 'L2') AS b, max(asr) FILTER (layer = 'L3') AS c
  FROM results GROUP BY ALL)
SELECT seed, tier, (a <= b AND b <= c) OR greatest(a, b, c) - least(a, b, c) <= 5 AS monotone FROM w""",
    }
    return found | {name: found[name].replace(FIRST_CLEAN, "") for name in WHOLE}
