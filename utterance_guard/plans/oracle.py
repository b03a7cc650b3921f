"""The registered queries once more, as DuckDB SQL, for the check of results."""

from __future__ import annotations

from utterance_guard.functions.text import BLANKS, HARASSMENT_LABEL, NONE_LABEL, PUNCTUATION
from utterance_guard.operators.cascade import EMPTY_REASON, ERROR_REASON, MODEL_SOURCE
from utterance_guard.operators.curate import AUGMENT_REASON, EVAL, TRAIN
from utterance_guard.operators.lexicon import PHRASE_MARKER
from utterance_guard.operators.review import ADD_PAIRS, ERFC, ERFC_T, WATCH
from utterance_guard.plans import fixed

MEMBERS = list(fixed.BIAS)
METRICS = ("accuracy", "precision", "recall", "f1")


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) for v in row) + ")" for row in rows)


STRIP = f"trim({{}}, '{BLANKS}')"
BARE = STRIP.format(f"translate({{}}, '{PUNCTUATION}', '')")


def _hash(seed: int, expr: str) -> str:
    return f"md5('{seed}:' || {expr})"


def _percent(digest: str) -> str:
    return f"('0x' || substr({digest}, 1, 8))::BIGINT * 100 / 4294967296.0"


def _side(seed: int, percent: float, expr: str = "text") -> str:
    return f"CASE WHEN {_percent(_hash(seed, expr))} < {percent} THEN '{EVAL}' ELSE '{TRAIN}' END"


DOCS = "docs AS (SELECT doc_id AS row_id, text, source FROM documents)"

LABELLED = """labelled AS (
    SELECT d.doc_id AS row_id, d.text, d.source, l.toxic AS label
    FROM documents d LEFT JOIN labels l USING (doc_id))"""

ONLY = LABELLED + """, labelled_only AS (
    SELECT * FROM labelled WHERE text IS NOT NULL AND label IS NOT NULL)"""

CLEAN = ONLY + """, clean AS (
    SELECT * FROM labelled_only
    WHERE row_id IN (SELECT min(row_id) FROM labelled_only GROUP BY text))"""

METRIC_COLUMNS = """
    tp + fp + fn + tn AS n, tp, fp, fn, tn,
    round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
    round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"""

RAW_METRICS = METRIC_COLUMNS.replace("round(", "(").replace(", 6)", ")")

CONFUSION = """
    count(*) FILTER (expected_label = 1 AND predicted = 1) AS tp,
    count(*) FILTER (expected_label = 0 AND predicted = 1) AS fp,
    count(*) FILTER (expected_label = 1 AND predicted = 0) AS fn,
    count(*) FILTER (expected_label = 0 AND predicted = 0) AS tn"""


WORD_LIST = "regexp_extract_all(lower(text), '\\p{L}+')"

# pairs of neighbouring characters, white space left out
PAIR_LIST = """list_transform(range(1, greatest(len(chars), 1)),
    lambda i: chars[i] || chars[i + 1])"""
CHARS = "regexp_extract_all(regexp_replace(lower(text), '\\s+', '', 'g'), '(?s).')"
PAIRS = f"CASE WHEN len(chars) = 1 THEN chars ELSE {PAIR_LIST} END"


def _scores(
    source: str, columns: str = "row_id", known: dict = fixed.WEIGHTS, toks: str = WORD_LIST
) -> str:
    """CTEs ``members`` and ``ensemble`` over ``source(row_id, text)``."""
    weights = _values((f"'{t}'", *w) for t, w in known.items())
    sums = ", ".join(
        f"coalesce(sum(w{m}::DECIMAL(18,4)), 0) + {b} AS z{m}" for m, b in fixed.BIAS.items()
    )
    names = ", ".join(f"w{m}" for m in MEMBERS)
    long = " UNION ALL ".join(
        f"SELECT {columns}, {m} AS seed, {i} AS pos, z{m}::DOUBLE AS margin FROM margins"
        for i, m in enumerate(MEMBERS)
    )
    using = columns
    return f"""weights AS (SELECT * FROM (VALUES {weights}) AS v(token, {names})),
    toks AS (
        SELECT {columns}, unnest({toks}) AS token
        FROM {source}),
    sums AS (
        SELECT {columns}, {", ".join(f"sum(w{m}::DECIMAL(18,4)) AS w{m}" for m in MEMBERS)}
        FROM toks JOIN weights USING (token) GROUP BY {columns}),
    margins AS (
        SELECT {columns},
            {", ".join(f"coalesce(w{m}, 0) + ({b}) AS z{m}" for m, b in fixed.BIAS.items())}
        FROM {source} LEFT JOIN sums USING ({using})),
    members AS (
        SELECT *, 1 / (1 + exp(margin)) AS p0, 1 / (1 + exp(-margin)) AS p1 FROM ({long})),
    ensemble AS (
        SELECT {columns}, avg(p0) AS p0, avg(p1) AS p1, max(p0) AS most0,
            string_agg(seed || ':' || CASE WHEN p1 > p0 THEN '{HARASSMENT_LABEL}'
                       ELSE '{NONE_LABEL}' END, ',' ORDER BY pos) AS seeds
        FROM members GROUP BY {columns})"""


def _lexicon(source: str, columns: str = "row_id") -> str:
    """CTE ``hits`` over ``source(row_id, text)``: words and sources as lists."""
    return f"""hits AS (
        SELECT {columns}, text,
            list_filter({_list(fixed.SUBSTRINGS)}, lambda w: contains(lower(text), w)) AS words,
            len(list_filter({_list(fixed.PHRASES)}, lambda w: contains(
                ' ' || trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ',
                ' ' || w || ' '))) > 0 AS phrase
        FROM {source})"""


REASON = """'blocklist(' || array_to_string(list_concat(
    list_transform(words, lambda w: 'list_a'), CASE WHEN phrase THEN ['list_b'] ELSE [] END),
    ',') || ')'"""


def _verdicts(source: str) -> str:
    """CTE ``verdicts``: the batch verdict of ``source(row_id, text)``."""
    return f"""{_scores(source)}, {_lexicon(source)},
    verdicts AS (
        SELECT row_id, h.text,
            len(words) > 0 OR phrase AS hit,
            CASE WHEN hit OR p1 > p0 THEN '{HARASSMENT_LABEL}' ELSE '{NONE_LABEL}' END AS label,
            CASE WHEN hit THEN 1.0 ELSE round(greatest(p0, p1), 4) END AS confidence,
            NOT hit AND greatest(p0, p1) BETWEEN 0.55 AND 0.70 AS needs_review,
            CASE WHEN hit THEN {REASON} ELSE '{MODEL_SOURCE}' END AS source
        FROM hits h JOIN ensemble USING (row_id))"""


JUDGED = f"""{DOCS}, {_verdicts("docs")}, judged AS (
    SELECT v.*, d.source AS area, l.toxic AS expected_label,
        (v.label = '{HARASSMENT_LABEL}')::INT AS predicted
    FROM verdicts v JOIN labels l ON l.doc_id = v.row_id
    JOIN documents d ON d.doc_id = v.row_id)"""

ENSEMBLE_JUDGED = f"""{DOCS}, {_scores("docs")}, judged AS (
    SELECT row_id, toxic AS expected_label, p1 FROM ensemble JOIN labels ON doc_id = row_id)"""

CUTS = ", ".join(f"({t})" for t in fixed.THRESHOLDS)

SWEEP = f"""{ENSEMBLE_JUDGED},
    cuts AS (SELECT t::DOUBLE AS threshold FROM (VALUES {CUTS}) AS v(t)),
    swept AS (
        SELECT threshold, {CONFUSION}
        FROM (SELECT threshold, expected_label, (p1 >= threshold)::INT AS predicted
              FROM judged, cuts) GROUP BY threshold)"""


def _seed_metrics(name: str, threshold: float) -> str:
    return f"""{name}_counts AS (
        SELECT seed, {CONFUSION} FROM (
            SELECT seed, toxic AS expected_label, (p1 > {threshold})::INT AS predicted
            FROM members JOIN labels ON doc_id = row_id) GROUP BY seed),
    {name}_long AS (
        UNPIVOT (SELECT accuracy, precision, recall, f1 FROM (
            SELECT {RAW_METRICS} FROM {name}_counts))
        ON accuracy, precision, recall, f1 INTO NAME metric VALUE value),
    {name} AS (
        SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS least,
            max(value) AS most FROM {name}_long GROUP BY metric)"""


def _augmented(source: str) -> str:
    return f"""bare AS (
        SELECT row_id, {BARE.format("text")} AS bare, label FROM {source}
        WHERE {BARE.format("text")} <> text),
    augmented AS (
        SELECT row_id, bare AS text, label FROM bare
        WHERE bare NOT IN (SELECT text FROM {source})
        AND row_id IN (SELECT min(row_id) FROM bare GROUP BY bare))"""


def _loose(text: str) -> str:
    return BARE.format(f"lower({text})")


WORDS = """words AS (
        SELECT word, min(item_id) AS ord FROM (
            SELECT item_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word
            FROM benchmark) GROUP BY word)"""


def _naive_bayes() -> str:
    sides = " UNION ALL ".join(
        f"SELECT {m} AS member, label, text FROM clean WHERE {_side(m, 15)} = '{TRAIN}'"
        for m in MEMBERS
    )
    return f"""{CLEAN}, sides AS ({sides}),
    counts AS (
        SELECT member, token, sum(label) AS toxic, count(*) AS n FROM (
            SELECT member, label,
                unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+'))) AS token
            FROM sides) GROUP BY member, token),
    odds AS (
        SELECT member, token,
            round(ln((toxic + 1.0)::DOUBLE / (n - toxic + 1.0)::DOUBLE), 4)::DECIMAL(18,4) AS w
        FROM counts),
    bias AS (SELECT * FROM (VALUES {_values(fixed.BIAS.items())}) AS v(member, b)),
    toks AS (
        SELECT doc_id AS row_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS token
        FROM documents),
    sums AS (SELECT row_id, member, sum(w) AS s FROM toks JOIN odds USING (token)
             GROUP BY row_id, member),
    margins AS (
        SELECT doc_id AS row_id, bias.member AS seed, (coalesce(s, 0) + b)::DOUBLE AS margin
        FROM documents CROSS JOIN bias LEFT JOIN sums
            ON sums.row_id = doc_id AND sums.member = bias.member)"""


def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["utterances_clean"] = f"""
        SELECT row_id, line::INT AS line, {STRIP.format("t")} AS text FROM (
            SELECT doc_id AS row_id, unnest(range(len(l))) AS line, unnest(l) AS t
            FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
        WHERE {STRIP.format("t")} <> ''"""
    sql["text_normalized"] = "SELECT doc_id AS row_id, lower(text) AS normal_text FROM documents"
    sql["punctuation_free"] = (
        f"SELECT doc_id AS row_id, {BARE.format('text')} AS text FROM documents"
    )
    hit = " OR ".join(f"contains(text, '{w}')" for w in fixed.KEYWORDS)
    sql["keyword_alerts"] = f"SELECT doc_id AS row_id, ({hit}) AS keyword FROM documents"
    sql["token_truncate"] = """
        SELECT row_id, len(t)::BIGINT AS n_tokens, least(len(t) + 2, 512)::BIGINT AS n_kept,
            array_to_string(list_concat(['[CLS]'], t[1:510], ['[SEP]']), ' ') AS input
        FROM (SELECT doc_id AS row_id, regexp_extract_all(lower(text), '\\p{L}+') AS t
              FROM documents)"""

    sql["blocklist_hits"] = f"""WITH {DOCS}, {_lexicon("docs")}
        SELECT row_id, len(words) > 0 AS matched, array_to_string(words, ',') AS words,
            CASE WHEN len(words) > 0 THEN 'blocklist(' || array_to_string(
                list_transform(words, lambda w: 'list_a'), ',') || ')' END AS reason
        FROM hits"""
    sql["blocklist_two_sources"] = f"""WITH {DOCS}, {_lexicon("docs")}
        SELECT row_id, pos::INT AS pos, word, source FROM (
            SELECT row_id, unnest(range(len(words))) AS pos, unnest(words) AS word,
                'list_a' AS source FROM hits
            UNION ALL
            SELECT row_id, len(words), '{PHRASE_MARKER}', 'list_b' FROM hits WHERE phrase)"""
    sql["blocklist_hits_large"] = f"""WITH {WORDS}, found AS (
            SELECT doc_id AS row_id, count(*) AS n,
                string_agg(word, ',' ORDER BY ord, word) AS words
            FROM documents JOIN words ON contains(lower(text), word) GROUP BY doc_id)
        SELECT doc_id AS row_id, coalesce(n, 0)::BIGINT AS n_hits,
            md5(coalesce(words, '')) AS words_md5
        FROM documents LEFT JOIN found ON row_id = doc_id"""

    scores = f"WITH {DOCS}, {_scores('docs')} "
    sql["member_scores"] = scores + """
        SELECT row_id, seed, round(margin, 6) AS margin, round(p1, 6) AS p1 FROM members"""
    sql["member_scores_large"] = f"""WITH {_naive_bayes()}
        SELECT row_id, seed, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS p1
        FROM margins"""
    z = [f"exp(z{m}::DOUBLE)" for m in MEMBERS]
    sql["softmax_scores"] = scores + "SELECT row_id, " + ", ".join(
        f"round({e} / ({' + '.join(z)}), 6) AS p{i}" for i, e in enumerate(z)
    ) + " FROM margins"
    sql["ensemble_scores"] = scores + f"""
        SELECT row_id, round(p0, 6) AS p0, round(p1, 6) AS p1,
            CASE WHEN p1 > p0 THEN '{HARASSMENT_LABEL}' ELSE '{NONE_LABEL}' END AS label,
            round(greatest(p0, p1), 6) AS confidence
        FROM ensemble"""
    sql["member_breakdown"] = scores + f"""
        SELECT row_id, pos, seed,
            CASE WHEN p1 > p0 THEN '{HARASSMENT_LABEL}' ELSE '{NONE_LABEL}' END AS label,
            round(greatest(p0, p1), 6) AS confidence
        FROM members"""

    verdicts = f"WITH {DOCS}, {_verdicts('docs')} "
    sql["verdicts_batch"] = (
        verdicts + "SELECT row_id, text, label, confidence, needs_review, source FROM verdicts"
    )
    sql["verdict_summary"] = verdicts + f"""
        SELECT count(*) AS n, count(*) FILTER (label = '{HARASSMENT_LABEL}') AS n_harassment,
            count(*) FILTER (needs_review) AS n_review FROM verdicts"""
    lines = f"""parts AS (
            SELECT doc_id * 2 AS speaker_id, doc_id AS part, text FROM documents
            UNION ALL
            SELECT conv_id * 2 + 1, conv_id * 1000 + turn, text FROM conversations),
        lines AS (
            SELECT speaker_id, part, unnest(range(len(l))) AS line, unnest(l) AS raw FROM (
                SELECT speaker_id, part, string_split(text, chr(10)) AS l FROM parts)),
        rows AS (
            SELECT speaker_id || '-' || part || '-' || line AS row_id, speaker_id, raw,
                {STRIP.format("raw")} AS text, ends_with(raw, '.') AS is_final FROM lines)"""
    sql["verdicts_online"] = f"""WITH {lines}, {_scores("rows")}, {_lexicon("rows")},
        judged AS (
            SELECT *, text = '' AS empty, text <> '' AND (len(words) > 0 OR phrase) AS hit
            FROM hits JOIN ensemble USING (row_id))
        SELECT row_id, NOT empty AND (hit OR p1 > p0) AS is_nondeli,
            CASE WHEN NOT empty AND (hit OR p1 > p0) THEN '{HARASSMENT_LABEL}'
                 ELSE '{NONE_LABEL}' END AS label,
            CASE WHEN empty OR hit THEN 1.0 ELSE round(greatest(p0, p1), 6) END AS confidence,
            CASE WHEN empty THEN '{EMPTY_REASON}' WHEN hit THEN {REASON}
                 ELSE '{MODEL_SOURCE}' END AS reason,
            CASE WHEN NOT (empty OR hit) THEN seeds END AS seeds
        FROM judged"""

    sql["profile"] = f"""WITH {ONLY}
        SELECT count(*) AS n_rows,
            count(*) FILTER (text IS NULL OR {STRIP.format("text")} = '') AS n_empty_text,
            (SELECT count(*) FROM labelled_only) AS n_complete,
            (SELECT count(DISTINCT text) FROM labelled_only) AS n_distinct,
            (SELECT count(*) - count(DISTINCT text) FROM labelled_only) AS n_removed
        FROM labelled"""
    sql["label_counts"] = f"""WITH {CLEAN}
        SELECT label, count(*) AS n FROM clean GROUP BY label"""
    sql["top_duplicates"] = """
        SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1
        ORDER BY n DESC, text LIMIT 10"""
    sql["labelled_clean"] = f"WITH {CLEAN} SELECT row_id, text, label FROM clean"
    sql["dedupe_first"] = """
        SELECT doc_id AS row_id, text FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
    sql["augment_rows"] = f"""WITH {ONLY}, {_augmented("labelled_only")}
        SELECT -1 - row_id AS row_id, row_id AS origin_id, text, label,
            1.0::DOUBLE AS confidence, '{AUGMENT_REASON}' AS reason,
            false AS needs_review FROM augmented"""
    sql["training_union"] = f"""WITH {CLEAN}, {_augmented("clean")}
        SELECT row_id, text, label FROM clean
        UNION ALL SELECT -1 - row_id, text, label FROM augmented"""
    sql["split_hash"] = f"SELECT doc_id AS row_id, {_side(42, 15)} AS side FROM documents"
    sql["split_exact"] = f"""WITH {CLEAN}
        SELECT row_id, label, CASE WHEN
            row_number() OVER (PARTITION BY label ORDER BY {_hash(42, "row_id")})
                <= (15 * count(*) OVER (PARTITION BY label) + 50) // 100
            THEN '{EVAL}' ELSE '{TRAIN}' END AS side FROM clean"""
    sql["leakage"] = f"""WITH {LABELLED}
        SELECT row_id, text FROM labelled WHERE label IS NOT NULL
        AND text IN (SELECT text FROM labelled WHERE label IS NULL)"""
    sql["leakage_removed"] = f"""WITH {LABELLED}
        SELECT row_id, text FROM labelled WHERE label IS NOT NULL AND {_loose("text")} NOT IN (
            SELECT {_loose("text")} FROM labelled WHERE label IS NULL)"""
    sql["fresh_holdout"] = f"""WITH {LABELLED}, drawn AS (
            SELECT row_id, text FROM labelled WHERE {_side(202402, 15)} = '{EVAL}'
            AND text NOT IN (SELECT text FROM labelled WHERE label IS NOT NULL)
            AND NOT {_side(202401, 15)} = '{EVAL}')
        SELECT * FROM drawn WHERE row_id IN (SELECT min(row_id) FROM drawn GROUP BY text)"""

    train = f"{CLEAN}, train AS (SELECT * FROM clean WHERE {_side(42, 15)} = '{TRAIN}')"
    sql["class_weights"] = f"""WITH {train}
        SELECT label, count(*) AS n,
            round((SELECT count(*) FROM train) / (2.0 * count(*)), 6)::DOUBLE AS weight
        FROM train GROUP BY label"""
    sql["training_rows"] = f"""WITH {train}
        SELECT row_id, label, '{TRAIN}' AS side, round((SELECT count(*) FROM train)
            / (2.0 * count(*) OVER (PARTITION BY label)), 6)::DOUBLE AS weight
        FROM train"""
    sql["export_gap"] = "SELECT doc_id AS row_id FROM documents WHERE false"
    cut = f"docs AS (SELECT doc_id AS row_id, text, {CHARS} AS chars FROM documents)"
    sql["tokens_bigram"] = f"""WITH {cut}
        SELECT row_id, len({PAIRS})::BIGINT AS n_tokens,
            md5(array_to_string({PAIRS}, '|')) AS tokens_md5 FROM docs"""
    sql["member_scores_bigram"] = f"""WITH {cut},
        {_scores("docs", known=fixed.PAIRS, toks=PAIRS)}
        SELECT row_id, seed, round(margin, 6) AS margin, round(p1, 6) AS p1 FROM members"""
    sql["weighted_logloss"] = f"""WITH {ENSEMBLE_JUDGED}, weights_by_class AS (
            SELECT expected_label,
                ((SELECT count(*) FROM judged) / (2.0 * count(*)))::DOUBLE AS weight
            FROM judged GROUP BY expected_label)
        SELECT count(*) AS n, round(sum(weight * -ln(
            CASE WHEN expected_label = 1 THEN p1 ELSE 1 - p1 END)) / sum(weight), 6) AS logloss
        FROM judged JOIN weights_by_class USING (expected_label)"""
    sql["binary_metrics"] = f"""WITH {JUDGED}
        SELECT {METRIC_COLUMNS} FROM (SELECT {CONFUSION} FROM judged)"""
    sql["mistakes"] = f"""WITH {JUDGED}
        SELECT row_id, text,
            CASE WHEN expected_label = 1 THEN '{HARASSMENT_LABEL}' ELSE '{NONE_LABEL}'
                END AS expected,
            label AS predicted, confidence
        FROM judged WHERE expected_label <> predicted"""
    sql["threshold_sweep"] = f"WITH {SWEEP} SELECT threshold, {METRIC_COLUMNS} FROM swept"
    sql["seed_summary"] = scores + f""", {_seed_metrics("run", 0.5)}
        SELECT metric, round(mean, 6) AS mean, round(std, 6) AS std, round(least, 6) AS "min",
            round(most, 6) AS "max" FROM run"""
    sql["run_comparison"] = scores + f""",
        {_seed_metrics("run_a", 0.5)}, {_seed_metrics("run_b", 0.6)}
        SELECT metric, round(a.mean, 6) AS mean_before, round(a.std, 6) AS std_before,
            round(b.mean, 6) AS mean_after, round(b.std, 6) AS std_after,
            round(b.mean - a.mean, 6) AS change,
            round(sqrt((a.std * a.std + b.std * b.std) / 2), 6) AS pooled_std,
            abs(b.mean - a.mean) > sqrt((a.std * a.std + b.std * b.std) / 2) AS clear
        FROM run_a a JOIN run_b b USING (metric)"""
    sql["best_candidate"] = f"""WITH RECURSIVE {SWEEP}, rounds AS (
            SELECT round(threshold * 20)::INT AS step, f1 FROM (
                SELECT threshold, {RAW_METRICS} FROM swept)),
        run AS (
            SELECT step, f1 AS top, step AS best, 0 AS waited FROM rounds WHERE step = 1
            UNION ALL
            SELECT r.step, greatest(r.f1, run.top),
                CASE WHEN r.f1 > run.top THEN r.step ELSE run.best END,
                CASE WHEN r.f1 > run.top THEN 0 ELSE run.waited + 1 END
            FROM run JOIN rounds r ON r.step = run.step + 1 WHERE run.waited < 2)
        SELECT best AS step, round(top, 6) AS f1 FROM run ORDER BY run.step DESC LIMIT 1"""
    changes = ", ".join(
        f"round({m} - lag({m}) OVER (ORDER BY unix_time), 6) AS {m}_change" for m in METRICS
    )
    sql["history_trend"] = f"""WITH {JUDGED}, runs AS (
            SELECT (1704067200 + regexp_extract(area, '\\d+')::BIGINT * 86400) AS unix_time,
                {RAW_METRICS} FROM (SELECT area, {CONFUSION} FROM judged GROUP BY area))
        SELECT unix_time, {", ".join(f"round({m}, 6) AS {m}" for m in METRICS)}, {changes}
        FROM runs"""

    sql["review_queue"] = f"""WITH {JUDGED}, queue AS (
            SELECT row_id, text, label, confidence, 'flagged' AS origin FROM verdicts
            WHERE needs_review
            UNION ALL
            SELECT row_id, text, label, confidence, 'reported' FROM judged
            WHERE expected_label <> predicted)
        SELECT *, (SELECT count(*) FROM queue) >= 20 AS ready FROM queue"""
    patterns = " UNION ALL ".join(
        f"SELECT '{name}' AS pattern FROM judged WHERE expected_label <> predicted "
        f"AND regexp_matches(text, '{p}')"
        for name, p in fixed.PATTERNS.items()
    )
    sql["error_patterns"] = f"""WITH {JUDGED}
        SELECT pattern, count(*) AS n,
            CASE WHEN count(*) >= 3 THEN '{ADD_PAIRS}' ELSE '{WATCH}' END AS action
        FROM ({patterns}) GROUP BY pattern"""
    sql["suspect_words"] = f"""WITH {JUDGED}, marked AS (
            SELECT text, (expected_label = 0 AND predicted = 1)::INT AS wrong FROM judged),
        overall AS (SELECT sum(wrong) / count(*) AS overall FROM marked),
        by_word AS (
            SELECT word, count(*) AS n, sum(wrong)::BIGINT AS n_wrong FROM (
                SELECT wrong,
                    unnest(list_distinct(regexp_extract_all(lower(text), '\\p{{L}}+'))) AS word
                FROM marked) GROUP BY word)
        SELECT word, n, n_wrong, round(n_wrong / n, 6) AS share, round(overall, 6) AS overall
        FROM by_word, overall WHERE n >= 5 AND n_wrong > 0 AND n_wrong / n >= 2.0 * overall"""
    sql["error_by_area"] = f"""WITH {JUDGED}
        SELECT area, count(*) AS n,
            count(*) FILTER (expected_label <> predicted) AS n_wrong,
            round(count(*) FILTER (expected_label <> predicted) / count(*), 6) AS error_share
        FROM judged GROUP BY area"""
    sql["monthly_review"] = f"""WITH {JUDGED}, both_kinds AS (
            SELECT row_id, 1 AS f, 0 AS r FROM verdicts WHERE needs_review
            UNION ALL
            SELECT row_id, 0, 1 FROM judged WHERE expected_label <> predicted)
        SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(f)::BIGINT AS n_flagged,
            sum(r)::BIGINT AS n_reported
        FROM both_kinds LEFT JOIN orders ON o_orderkey = row_id GROUP BY 1"""

    sql["stream_alerts"] = f"""WITH {lines},
        final AS (SELECT * FROM rows WHERE is_final),
        {_scores("final")}, {_lexicon("final")}, judged AS (
            SELECT h.*, speaker_id, raw, p0, p1, h.text = '' AS empty,
                h.text <> '' AND (len(words) > 0 OR phrase) AS hit
            FROM hits h JOIN ensemble USING (row_id) JOIN final USING (row_id))
        SELECT row_id, speaker_id, ({hit.replace("text", "raw")}) AS keyword,
            NOT empty AND (hit OR p1 > p0) AS is_nondeli,
            CASE WHEN empty THEN '{EMPTY_REASON}' WHEN hit THEN {REASON}
                 ELSE '{MODEL_SOURCE}' END AS reason,
            ({hit.replace("text", "raw")}) OR (NOT empty AND (hit OR p1 > p0)) AS alert
        FROM judged"""
    sql["alert_episodes"] = """WITH gaps AS (
            SELECT user_id, epoch_us(ts) AS us,
                lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
        numbered AS (
            SELECT *, sum((prev IS NULL OR us > prev + 7200000000)::INT) OVER (
                PARTITION BY user_id ORDER BY us) AS episode FROM gaps)
        SELECT user_id AS speaker_id, min(us) AS first_us, max(us) AS last_us,
            count(*) AS n_alerts
        FROM numbered GROUP BY user_id, episode"""
    sql["daily_verdicts"] = verdicts + f"""
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n,
            count(*) FILTER (label = '{HARASSMENT_LABEL}') AS n_harassment,
            count(*) FILTER (needs_review) AS n_review
        FROM verdicts JOIN events ON event_id = row_id GROUP BY 1"""
    sql["outside_scores"] = sql["member_scores"]
    refused = f"NOT empty AND NOT hit AND length(text) > {fixed.OUTSIDE_CHARS}"
    keyword = hit.replace("text", "raw")
    sql["alerts_with_failures"] = f"""WITH {lines},
        final AS (SELECT * FROM rows WHERE is_final),
        {_scores("final")}, {_lexicon("final")}, judged AS (
            SELECT h.*, raw, p0, p1, h.text = '' AS empty,
                h.text <> '' AND (len(words) > 0 OR phrase) AS hit
            FROM hits h JOIN ensemble USING (row_id) JOIN final USING (row_id)),
        told AS (
            SELECT *, {refused} AS refused,
                CASE WHEN NOT ({refused}) THEN NOT empty AND (hit OR p1 > p0) END AS is_nondeli
            FROM judged)
        SELECT row_id, ({keyword}) AS keyword, is_nondeli,
            CASE WHEN empty THEN '{EMPTY_REASON}' WHEN hit THEN {REASON}
                 WHEN refused THEN '{ERROR_REASON}' ELSE '{MODEL_SOURCE}' END AS reason,
            ({keyword}) OR coalesce(is_nondeli, false) AS alert,
            CASE WHEN refused THEN 'ValueError: ' || length(text) || ' characters' END AS error
        FROM told"""
    sql["latest_transcripts"] = f"""
        SELECT conv_id AS speaker_id, turn::BIGINT AS result_no, true AS is_final,
            md5(text) AS text_md5, ({hit}) AS keyword FROM conversations"""
    sql["episode_signals"] = f"""WITH e AS ({sql["alert_episodes"]})
        SELECT speaker_id, 'open' AS signal, first_us, NULL::BIGINT AS last_us,
            NULL::BIGINT AS n_alerts FROM e
        UNION ALL SELECT speaker_id, 'closed', first_us, last_us, n_alerts FROM e"""
    sql["utterance_lines"] = f"""
        SELECT row_id, {STRIP.format("t")} AS text FROM (
            SELECT row_number() OVER (ORDER BY doc_id, line) - 1 AS row_id, t FROM (
                SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l
                      FROM documents)))
        WHERE {STRIP.format("t")} <> ''"""
    sql["split_texts"] = f"""WITH {ONLY}, g AS (
            SELECT {_hash(42, "text")} AS h, min(label) AS s, count(*) AS n
            FROM labelled_only GROUP BY 1),
        c AS (
            SELECT h, n, sum(n) OVER (PARTITION BY s ORDER BY h) - n AS before,
                sum(n) OVER (PARTITION BY s) AS total FROM g)
        SELECT row_id, label,
            CASE WHEN 100 * (2 * before + n) <= 30 * total THEN '{EVAL}' ELSE '{TRAIN}' END AS side
        FROM labelled_only JOIN c ON h = {_hash(42, "text")}"""
    four = METRIC_COLUMNS.replace(", 6)", ", 4)")
    sql["history_runs"] = f"""WITH {JUDGED}
        SELECT unix_time, n AS n_eval_samples, accuracy, precision, recall, f1
        FROM (SELECT {four} FROM (SELECT {CONFUSION} FROM judged))
        CROSS JOIN (VALUES (1704070800::BIGINT), (1704074400::BIGINT)) AS v(unix_time)"""
    sql["mined_endings"] = f"""WITH {JUDGED}, r AS (
            SELECT {STRIP.format("text")} AS t, (expected_label <> predicted)::INT AS wrong
            FROM judged),
        e AS (
            SELECT wrong, unnest(list_transform(range(1, least(length(t), 6) + 1),
                lambda n: right(t, n))) AS ending FROM r WHERE t <> ''),
        c AS (
            SELECT ending, count(*) AS n, sum(wrong)::BIGINT AS n_wrong FROM e
            GROUP BY 1 HAVING sum(wrong) >= 3),
        x AS (
            SELECT substr(ending, 2) AS ending, max(n_wrong) AS most FROM c
            WHERE length(ending) > 1 GROUP BY 1)
        SELECT ending, n, n_wrong, round(n_wrong / n, 6) AS share, '{ADD_PAIRS}' AS action
        FROM c LEFT JOIN x USING (ending) WHERE coalesce(most, 0) < n_wrong"""
    sql["training_store"] = sql["training_union"]
    sql["fit_residual"] = "SELECT 0 AS feature, 0.0::DOUBLE AS residual WHERE false"
    sql["selection_gap"] = "SELECT 0 AS step WHERE false"
    part = "CASE WHEN {0} > 0 THEN {0} * ln({0} / ({1} * {2})) ELSE 0 END"
    share = "((a + b) / (c + d))"
    gain = " + ".join(part.format(*x) for x in (
        ("a", "c", share), ("b", "d", share), ("(c - a)", "c", f"(1 - {share})"),
        ("(d - b)", "d", f"(1 - {share})")))
    tail = "0.0"
    for factor in reversed(ERFC):
        tail = f"(({tail} + ({factor})) * t)"
    sql["new_areas"] = f"""WITH {JUDGED}, wrong AS (
            SELECT row_id, text, year(o_orderdate) >= {fixed.NEW_YEAR} AS is_new
            FROM judged JOIN orders ON o_orderkey = row_id WHERE expected_label <> predicted),
        total AS (
            SELECT (count(*) FILTER (is_new))::DOUBLE AS c,
                (count(*) FILTER (NOT is_new))::DOUBLE AS d FROM wrong),
        counted AS (
            SELECT word, (count(*) FILTER (is_new))::DOUBLE AS a,
                (count(*) FILTER (NOT is_new))::DOUBLE AS b
            FROM (SELECT is_new, unnest(list_distinct({WORD_LIST})) AS word FROM wrong)
            GROUP BY word HAVING count(*) >= 3),
        tested AS (
            SELECT *, CASE WHEN c = 0 OR d = 0 THEN 0.0
                ELSE greatest(0.0, round(2 * ({gain}), 6)) END AS ratio FROM counted, total),
        stepped AS (SELECT *, floor(ratio * 100) AS step FROM tested),
        steps AS (
            SELECT step, count(*) AS n, 1 / (1 + {ERFC_T} * sqrt(step / 200)) AS t
            FROM stepped GROUP BY step),
        ranked AS (
            SELECT *, sum(n) OVER (ORDER BY step DESC) AS upto, sum(n) OVER () AS everything
            FROM steps),
        held AS (
            SELECT min(step) AS cut FROM ranked
            WHERE {tail} * exp(-step / 200) <= 0.05 * upto / everything)
        SELECT word, a::BIGINT AS n_new, b::BIGINT AS n_old, ratio,
            coalesce(step >= cut AND a * d > b * c, false) AS new_area
        FROM stepped, held"""
    return sql
