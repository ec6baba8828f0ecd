"""SQL of the queries for DuckDB, written apart from the DataFrame code: common tables, then a query on them."""

from __future__ import annotations

import re

from inkstone.operators import features as X

A = "⎇"
TOKEN = r"[\p{L}\p{N}]+(?:[''’]\p{L}+)*|[^\s\p{L}\p{N}]"
SEGMENT, TAIL = 200, 100


def words(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S+'))"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def cleaned(c: str) -> str:
    c = f"regexp_replace({c}, '`[^`]*`', '{A}', 'g')"
    c = rf"regexp_replace({c}, '\$\$?[^$]*\$\$?', '{A}', 'g')"
    return rf"regexp_replace({c}, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g')"


def names(items) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


T: dict[str, str] = {}
T["lines"] = "SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
T["paras"] = f"SELECT doc_id, line - 1 AS para_id, line AS start_line, line AS end_line, t AS text FROM (SELECT doc_id, line, {strip(cleaned('text'))} AS t FROM lines) WHERE t <> ''"
T["cut"] = rf"SELECT doc_id, para_id, start_line AS line, list_filter(string_split(regexp_replace(text, '([.!?])\s+([A-Z{A}(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {words('x')} >= 3) AS s FROM paras"
T["sents"] = f"SELECT doc_id, para_id, line, sent_id, text, {words('text')}::INT AS n_words FROM (SELECT doc_id, para_id, line, unnest(range(len(s)))::INT AS sent_id, unnest(s) AS text FROM cut)"
T["human"] = "SELECT DISTINCT doc_id FROM labels WHERE quality = 1"


def conditions() -> dict[str, str]:
    is_in = lambda c, *w: f"{c} IN {names([x for y in w for x in y])}"
    end, clause = X.END, [",", ";", ":"]
    part = lambda c: f"regexp_matches({c}, '^[a-z]{{2,}}(ed|en)$')"
    adv = lambda c: f"regexp_matches({c}, '^[a-z]{{2,}}ly$')"
    start = f"(p1 IS NULL OR {is_in('p1', end)})"
    passive = f"({is_in('t', X.BE)} AND ({part('n1')} OR ({adv('n1')} AND {part('n2')})))"
    by = f"(CASE WHEN {part('n1')} THEN n2 = 'by' ELSE n3 = 'by' END)"
    dem = f"({is_in('n1', X.AUX)} OR {is_in('n1', end, clause)} OR regexp_matches(n1, '^[a-z]{{2,}}(ed|s)$'))"
    out = {f: is_in("t", w.split()) for f, w in X.LEXICON.items()}
    out |= {
        "f_02_perfect_aspect": f"{is_in('t', X.HAVE)} AND ({part('n1')} OR {part('n2')} OR {part('n3')})",
        "f_10_demonstrative_pronoun": f"{is_in('t', X.DEMONSTRATIVES)} AND {dem}",
        "f_13_wh_question": f"{start} AND {is_in('t', X.WH)} AND {is_in('n1', X.AUX)}",
        "f_14_nominalizations": "regexp_matches(t, '^[a-z]{2,}(tion|ment|ness|ity|tions|ments|nesses|ities)$') AND length(t) > 5",
        "f_17_agentless_passives": f"{passive} AND NOT coalesce({by}, false)",
        "f_18_by_passives": f"{passive} AND {by}",
        "f_19_be_main_verb": f"{is_in('t', X.BE)} AND ({is_in('n1', X.DETERMINERS)} OR {is_in('n1', X.PREPOSITIONS)})",
        "f_20_existential_there": f"t = 'there' AND {is_in('n1', X.BE)}",
        "f_21_that_verb_comp": f"{is_in('t', X.PUBLIC_PRIVATE)} AND n1 = 'that'",
        "f_22_that_adj_comp": f"{is_in('t', X.COMPLEMENT_ADJECTIVES)} AND n1 = 'that'",
        "f_23_wh_clause": f"{is_in('t', X.PUBLIC_PRIVATE)} AND {is_in('n1', X.WH)}",
        "f_24_infinitives": f"t = 'to' AND regexp_matches(n1, '^[a-z]+$') AND NOT {is_in('n1', X.DETERMINERS, X.SUBJECTS, X.PREPOSITIONS)}",
        "f_25_present_participle": f"({start} OR p1 = ',') AND regexp_matches(t, '^[a-z]{{3,}}ing$')",
        "f_26_past_participle": f"({start} OR p1 = ',') AND {part('t')}",
        "f_33_pied_piping": f"{is_in('t', X.PREPOSITIONS)} AND n1 IN ('which', 'whom', 'whose', 'who')",
        "f_34_sentence_relatives": "t = ',' AND n1 = 'which'",
        "f_42_adverbs": adv("t"),
        "f_50_discourse_particles": f"{start} AND {is_in('t', X.PARTICLES)}",
        "f_51_demonstratives": f"{is_in('t', X.DEMONSTRATIVES)} AND NOT coalesce({dem}, false)",
        "f_59_contractions": "regexp_matches(t, '^[a-z]+[''’](s|t|re|ve|ll|d|m)$')",
        "f_61_stranded_preposition": f"{is_in('t', X.PREPOSITIONS)} AND {is_in('n1', end, clause)}",
        "f_62_split_infinitive": f"t = 'to' AND {adv('n1')} AND regexp_matches(n2, '^[a-z]+$')",
        "f_63_split_auxiliary": f"{is_in('t', X.AUX)} AND {adv('n1')} AND regexp_matches(n2, '^[a-z]{{3,}}$')",
        "f_65_clausal_coordination": f"t IN ('and', 'but', 'or') AND ({start} OR (p1 = ',' AND {is_in('n1', X.SUBJECTS, X.DEMONSTRATIVES)}))",
        "f_66_neg_synthetic": r"t IN ('neither', 'nor') OR (t = 'no' AND regexp_matches(n1, '^[\p{L}\p{N}]'))",
        "f_67_neg_analytic": "t = 'not' OR regexp_matches(t, '^[a-z]+n[''’]t$')",
    }
    return out


def feature_table(source: str, key: str) -> tuple[str, str]:
    """Two tables: the tokens of ``source`` with neighbours, and their counts by feature, long."""
    toks = f"SELECT {key}, k, l[k + 1] AS t, CASE WHEN k >= 1 THEN l[k] END AS p1, l[k + 2] AS n1, l[k + 3] AS n2, l[k + 4] AS n3 FROM (SELECT {key}, l, unnest(range(len(l))) AS k FROM (SELECT {key}, regexp_extract_all(lower(text), '{TOKEN}') AS l FROM {source}))"
    sums = ", ".join(f"count(*) FILTER (WHERE {c}) AS {f}" for f, c in conditions().items())
    words_ = r"count(*) FILTER (WHERE regexp_matches(t, '^[\p{L}\p{N}]')) AS tokens"
    wide = f"SELECT {key}, {words_}, {sums} FROM @toks GROUP BY ALL"
    long = f"SELECT {key}, feature, n, tokens, 1000.0::DOUBLE * n / tokens AS rate FROM (UNPIVOT ({wide}) ON {', '.join(conditions())} INTO NAME feature VALUE n) WHERE tokens > 0"
    return toks, long


def _features() -> None:
    T["doc_toks"], long = feature_table("documents", "doc_id")
    T["feats"] = long.replace("@toks", "doc_toks")
    T["seg_toks"], long = feature_table("segs", "doc_id, seg_id, words")
    T["seg_feats"] = long.replace("@toks", "seg_toks")


def greedy(source: str, size: str, least: int, tail: int) -> str:
    """Recursive table @w of (doc_id, i, g, held), then each row's group; a short rest joins the group before."""
    return (
        f"SELECT doc_id, i, 0 AS g, {size}::BIGINT AS x, {size}::BIGINT AS held FROM {source} WHERE i = 1 UNION ALL "
        f"SELECT s.doc_id, s.i, CASE WHEN w.held >= {least} THEN w.g + 1 ELSE w.g END, s.{size}::BIGINT, CASE WHEN w.held >= {least} THEN 0 ELSE w.held END + s.{size} "
        f"FROM @w w JOIN {source} s ON s.doc_id = w.doc_id AND s.i = w.i + 1"
    )


def grouped(walk: str, least: int, tail: int) -> str:
    return (
        f"SELECT doc_id, i, CASE WHEN g = last_g AND last_held < {least} AND last_held < {tail} AND g > 0 THEN g - 1 ELSE g END AS g FROM "
        f"(SELECT *, max(g) OVER (PARTITION BY doc_id) AS last_g, arg_max(held, i) OVER (PARTITION BY doc_id) AS last_held FROM {walk})"
    )


T["para_words"] = f"SELECT *, {words('text')} AS words, row_number() OVER (PARTITION BY doc_id ORDER BY para_id) AS i FROM paras"
T["seg_walk"] = greedy("para_words", "words", SEGMENT, TAIL).replace("@w", "seg_walk")
T["seg_groups"] = grouped("seg_walk", SEGMENT, TAIL)
T["segs"] = "SELECT doc_id, g AS seg_id, min(start_line) AS start_line, max(end_line) AS end_line, sum(words)::BIGINT AS words, string_agg(text, chr(10) || chr(10) ORDER BY para_id) AS text FROM para_words JOIN seg_groups USING (doc_id, i) GROUP BY doc_id, g"
T["seg_walk_1000"] = greedy("para_words", "words", 1000, 500).replace("@w", "seg_walk_1000")
T["seg_groups_1000"] = grouped("seg_walk_1000", 1000, 500)


def _clean_sentence() -> str:
    c = f"replace(replace(replace(text, '{A}', ''), '**', ''), '`', '')"
    c = rf"regexp_replace(regexp_replace({c}, '(\s)\*', '\1', 'g'), '\*(\s)', '\1', 'g')"
    c = rf"regexp_replace(regexp_replace({c}, '~+', ' ', 'g'), '\s+', ' ', 'g')"
    return f"trim({c}, ' ,;:')"


T["cleaned"] = f"SELECT doc_id, para_id, sent_id, line, {_clean_sentence()} AS text FROM sents"
T["scored"] = (
    rf"SELECT doc_id, row_number() OVER w - 1 AS sent, line, text, {words('text')}::INT AS n_words, "
    rf"CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0 THEN 2 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= length(regexp_replace(text, '\s', '', 'g')) ELSE false END AS prose, "
    rf"(sum(strlen(text) + 1) OVER w)::BIGINT - strlen(text) - 1 AS start_byte, (sum(strlen(text) + 1) OVER w)::BIGINT - 1 AS end_byte "
    rf"FROM cleaned WHERE {words('text')} >= 4 WINDOW w AS (PARTITION BY doc_id ORDER BY para_id, sent_id ROWS UNBOUNDED PRECEDING)"
)
T["fit"] = "SELECT * EXCLUDE (c) FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM scored) WHERE c >= 5"


def unit_tables(source: str, mark: str) -> None:
    T[f"unit_in{mark}"] = f"SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent) AS i FROM {source} WHERE prose"
    T[f"unit_walk{mark}"] = greedy(f"unit_in{mark}", "n_words", 12, 12).replace("@w", f"unit_walk{mark}")
    T[f"unit_groups{mark}"] = grouped(f"unit_walk{mark}", 12, 12)
    T[f"units{mark}"] = f"SELECT doc_id, g AS unit_id, min(line) AS line, count(*) AS n_sents, sum(n_words)::BIGINT AS words, string_agg(text, ' ' ORDER BY sent) AS text, list(sent) AS sents FROM unit_in{mark} JOIN unit_groups{mark} USING (doc_id, i) GROUP BY doc_id, g"


unit_tables("scored", "")
unit_tables("fit", "_fit")
T["sent_toks"] = f"SELECT doc_id, sent, unnest(range(len(l))) AS k, unnest(l) AS token FROM (SELECT doc_id, sent, regexp_extract_all(lower(text), '{TOKEN}') AS l FROM fit)"
T["score_toks"] = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent, k) - 1 AS pos, sent, token, regexp_matches(token, '[a-z]') AS is_content FROM sent_toks"
T["excess"] = (
    "SELECT word, n_in, n_out, ((n_in + 0.5::DOUBLE) / (ti + 1.0::DOUBLE)) / ((n_out + 0.5::DOUBLE) / (t_o + 1.0::DOUBLE)) AS ratio FROM "
    "(SELECT word, count(*) FILTER (WHERE quality = 0) AS n_in, count(*) FILTER (WHERE quality <> 0) AS n_out FROM label_words GROUP BY word), "
    "(SELECT count(*) FILTER (WHERE quality = 0) AS ti, count(*) FILTER (WHERE quality <> 0) AS t_o FROM label_words) "
    "WHERE n_in >= 20 AND ((n_in + 0.5::DOUBLE) / (ti + 1.0::DOUBLE)) / ((n_out + 0.5::DOUBLE) / (t_o + 1.0::DOUBLE)) >= 2.0"
)
T["label_words"] = "SELECT quality, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents JOIN labels USING (doc_id)"


WORD = r"[\p{L}\p{N}]+(?:[''’\-][\p{L}\p{N}]+)*"
T["line_words"] = (
    f"SELECT doc_id, line, word, (sum(length(gap)) OVER w + sum(length(word)) OVER w - length(word) + 1)::BIGINT AS span_start FROM (SELECT doc_id, line, unnest(range(len(ws))) AS i, unnest(ws) AS word, unnest(gs[1:len(ws)]) AS gap FROM "
    f"(SELECT doc_id, line, regexp_extract_all(text, '{WORD}') AS ws, string_split_regex(text, '{WORD}') AS gs FROM lines)) WINDOW w AS (PARTITION BY doc_id, line ORDER BY i ROWS UNBOUNDED PRECEDING)"
)


#: Hits of patterns on lines: each match cut off behind a sign, so that its place is the length of what is before.
def plain_hits(rule: str, level: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    marked = rf"string_split(regexp_replace(text, '({p})', chr(1) || '\1', 'g'), chr(1))"
    n = f"len(regexp_extract_all(text, '{p}'))"
    return (
        f"SELECT doc_id, line, '{rule}' AS rule, {level} AS severity, unnest(regexp_extract_all(text, '{p}')) AS match, "
        f"unnest(list_transform(range(1, {n} + 1), lambda i: length(list_aggregate({marked}[1:i], 'string_agg', '')) + 1)) AS span_start FROM lines WHERE regexp_matches(text, '{p}')"
    )


T["lex"] = (
    "SELECT doc_id, line, 'excess_words' AS rule, CASE WHEN ratio >= 4 THEN 0.6 ELSE 0.3 END AS severity, line_words.word AS match, span_start "
    "FROM line_words JOIN excess ON lower(line_words.word) = excess.word "
    f"UNION ALL {plain_hits('semicolon_usage', '0.3', ';')} UNION ALL {plain_hits('em_dash_usage', '0.3', '—')} "
    f"UNION ALL {plain_hits('not_just_but', '0.6', '(?i)\\bnot (?:just|only|merely)\\b[^.!?]{1,80}?\\bbut\\b')}"
)
T["mend_hits"] = (
    "SELECT doc_id, line, word AS match, span_start - 1 AS s, span_start - 1 + length(word) AS e, kind, repl FROM line_words JOIN "
    "(VALUES ('thing', 'replace', 'item'), ('idiot', 'replace', 'person'), ('than', 'replace', 'then'), ('trash', 'delete', NULL), ('pathetic', 'delete', NULL), ('stupid', 'delete', NULL)) r(w, kind, repl) ON lower(word) = w "
    f"UNION ALL SELECT doc_id, line, match, span_start - 1, span_start, 'split', NULL FROM ({plain_hits('semicolon_usage', '0.3', ';')})"
)
T["mend_marks"] = (
    r"SELECT *, length(regexp_extract(substr(text, s + 1), '^;\s*')) AS gap, e + length(regexp_extract(substr(text, e + 1), '^,?\s*')) AS after, s = 0 OR regexp_matches(substr(text, 1, s), '[.!?]\s+$') AS initial "
    "FROM mend_hits JOIN lines USING (doc_id, line)"
)
T["mend_edits"] = (
    "SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY start DESC, stop DESC, new DESC) AS i FROM (SELECT doc_id, line, text, s AS start, "
    r"CASE WHEN kind = 'replace' THEN e WHEN kind = 'split' THEN s + gap + 1 WHEN initial AND regexp_matches(substr(text, after + 1, 1), '^\p{Ll}') THEN after + 1 ELSE after END AS stop, "
    r"CASE WHEN kind = 'replace' THEN CASE WHEN regexp_matches(match, '^\p{Lu}') THEN upper(repl[1]) || repl[2:] ELSE repl END WHEN kind = 'split' THEN '. ' || upper(substr(text, s + gap + 1, 1)) "
    r"WHEN initial AND regexp_matches(substr(text, after + 1, 1), '^\p{Ll}') THEN upper(substr(text, after + 1, 1)) ELSE '' END AS new "
    r"FROM mend_marks WHERE kind <> 'split' OR (gap > 0 AND regexp_matches(substr(text, s + gap + 1, 1), '^\p{L}$')))"
)
T["mend_walk"] = (
    "SELECT doc_id, line, 0::BIGINT AS i, text, text AS t, length(text)::BIGINT AS edge, 0 AS n FROM (SELECT DISTINCT doc_id, line, text FROM mend_edits) UNION ALL "
    "SELECT w.doc_id, w.line, m.i, w.text, CASE WHEN m.stop <= w.edge THEN substr(w.t, 1, m.start::BIGINT) || m.new || substr(w.t, m.stop::BIGINT + 1) ELSE w.t END, CASE WHEN m.stop <= w.edge THEN m.start ELSE w.edge END::BIGINT, "
    "CASE WHEN m.stop <= w.edge THEN w.n + 1 ELSE w.n END FROM mend_walk w JOIN mend_edits m ON m.doc_id = w.doc_id AND m.line = w.line AND m.i = w.i + 1"
)
T["scv"] = "SELECT doc_id, count(*) AS sentences, stddev_samp(n_words) / avg(n_words) AS cv FROM sents GROUP BY doc_id HAVING count(*) >= 15"
T["pcv"] = f"SELECT doc_id, count(*) AS paragraphs, stddev_samp(n) / avg(n) AS cv FROM (SELECT doc_id, {words('text')} AS n FROM paras) WHERE n >= 10 GROUP BY doc_id HAVING count(*) >= 8"
T["generic"] = (
    rf"SELECT doc_id, para_id, start_line AS line, {words('text')} AS words, array_to_string(regexp_extract_all(text, '\S+')[1:8], ' ') || '…' AS match FROM paras "
    rf"WHERE {words('text')} >= 50 AND NOT regexp_matches(text, '[0-9{A}]') AND NOT regexp_matches(text, '[^\w\s][A-Z][a-z]{{2,}}|[^.!?]\s[A-Z][a-z]{{2,}}')"
)
T["heur"] = (
    "SELECT doc_id, 0 AS line, 'uniform_sentences' AS rule, 0.6 AS severity, '' AS match FROM scv WHERE cv < 0.40 UNION ALL "
    "SELECT doc_id, 0, 'uniform_paragraphs', 0.6, '' FROM pcv WHERE cv < 0.35 UNION ALL SELECT doc_id, line, 'generic_paragraph', 0.5, match FROM generic"
)
T["found"] = (
    "SELECT doc_id, line, span_start::INT AS span_start, (span_start + length(match) - 1)::INT AS span_end, 'lexical' AS layer, rule, severity::DOUBLE AS severity, match FROM lex UNION ALL "
    "SELECT doc_id, line, 0, 0, 'heuristic', rule, severity::DOUBLE, match FROM heur"
)
T["merge_in"] = "SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY severity DESC, span_start, span_end, rule, layer, match) AS i FROM found WHERE line > 0"
T["merge_walk"] = (
    "SELECT doc_id, line, i, true AS ok, [{'s': span_start, 'e': span_end}] AS acc FROM merge_in WHERE i = 1 UNION ALL "
    "SELECT m.doc_id, m.line, m.i, len(list_filter(acc, lambda k: k.s < m.span_end AND m.span_start < k.e)) = 0, "
    "CASE WHEN len(list_filter(acc, lambda k: k.s < m.span_end AND m.span_start < k.e)) = 0 THEN list_append(acc, {'s': m.span_start, 'e': m.span_end}) ELSE acc END "
    "FROM merge_walk w JOIN merge_in m ON m.doc_id = w.doc_id AND m.line = w.line AND m.i = w.i + 1"
)
T["merged"] = "SELECT m.* EXCLUDE (i) FROM merge_in m JOIN merge_walk w ON m.doc_id = w.doc_id AND m.line = w.line AND m.i = w.i WHERE ok UNION ALL SELECT * FROM found WHERE line <= 0"
T["dense"] = "SELECT doc_id, 1000.0::DOUBLE * coalesce(s, 0) / greatest(1, words) AS strong, 1000.0::DOUBLE * coalesce(n, 0) / greatest(1, words) AS every FROM doc_words LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE severity >= 0.6) AS s, count(*) AS n FROM found WHERE layer = 'lexical' GROUP BY doc_id) USING (doc_id)"
MESSAGES = {
    "excess_words": "A word in excess.", "semicolon_usage": "A semicolon.", "em_dash_usage": "An em dash.", "not_just_but": "The scaffold 'not just X but Y'.",
    "uniform_sentences": "Sentence lengths vary little.", "uniform_paragraphs": "Paragraph lengths vary little.", "generic_paragraph": "A long paragraph names nothing concrete.",
}
T["report_rows"] = (
    "SELECT doc_id, line, span_start, rule, '{\"line\":' || line || ',\"span_start\":' || span_start || ',\"span_end\":' || span_end || ',\"layer\":\"' || layer || '\",\"rule\":\"' || rule || '\",\"severity\":' || severity || "
    "',\"message\":\"' || CASE rule " + " ".join(f"WHEN '{r}' THEN '{m.replace(chr(39), 2 * chr(39))}'" for r, m in MESSAGES.items()) + " END || '\",\"match\":' || to_json(match)::VARCHAR || '}' AS j FROM merged"
)
T["report_meta"] = (
    f"SELECT doc_id, '{{\"doc_id\":' || doc_id || ',\"paragraphs\":' || p || ',\"words\":' || w || ',\"sentences\":' || coalesce(s, 0) || coalesce(',\"sentence_cv\":' || round(scv.cv, 3), '') || coalesce(',\"paragraph_cv\":' || round(pcv.cv, 3), '') || '}}' AS m "
    f"FROM (SELECT doc_id, count(*) AS p, sum({words('text')})::BIGINT AS w FROM paras GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS s FROM sents GROUP BY doc_id) USING (doc_id) LEFT JOIN scv USING (doc_id) LEFT JOIN pcv USING (doc_id)"
)
T["doc_words"] = f"SELECT doc_id, sum({words('text')})::BIGINT AS words FROM paras GROUP BY doc_id"


def nearest(c: str, q: float) -> str:
    return f"list_sort(list({c}))[1 + round_even({q}::DOUBLE * (count({c}) - 1), 0)::INT]"


def bands_of(source: str, by: str, c: str, digits: int | None) -> str:
    show = (lambda e: f"round({e}, {digits})") if digits is not None else (lambda e: e)
    return f"SELECT {by}, count({c}) AS n, {show(nearest(c, 0.05))} AS p05, {show(nearest(c, 0.5))} AS p50, {show(nearest(c, 0.95))} AS p95 FROM {source} GROUP BY {by}"


T["human_feats"] = "SELECT * FROM feats WHERE tokens >= 300 AND doc_id IN (SELECT doc_id FROM human)"
T["raw_bands"] = bands_of("human_feats", "feature", "rate", None)
T["profile"] = f"SELECT * FROM seg_feats WHERE words >= {TAIL} AND doc_id IN (SELECT doc_id FROM human)"
KEY = "|".join(X.KEY_TELLS)
T["deviating"] = (
    f"SELECT doc_id, feature, rate, CASE WHEN rate > p95 THEN 1 ELSE -1 END AS side, (CASE WHEN rate > p95 THEN rate - p95 ELSE p05 - rate END) / greatest(p95 - p05, 1e-9::DOUBLE) AS sigma, "
    f"regexp_matches(feature, '{KEY}') AS key FROM feats JOIN raw_bands USING (feature) WHERE rate < p05 OR rate > p95"
)
T["ref"] = "SELECT feature, count(*) AS rn, quantile_cont(rate, 0.05) AS q05, quantile_cont(rate, 0.95) AS q95, min(rate) AS lo, max(rate) AS hi FROM profile GROUP BY feature"
T["rate_counts"] = "SELECT feature, rate, sum(k) AS k FROM (SELECT feature, rate, 1 AS k FROM profile UNION ALL SELECT feature, rate, 0 FROM seg_feats) GROUP BY feature, rate"
T["rate_ranks"] = "SELECT feature, rate, sum(k) OVER (PARTITION BY feature ORDER BY rate) AS upto, sum(k) OVER (PARTITION BY feature ORDER BY rate DESC) AS from_, sum(k) OVER (PARTITION BY feature) AS rn FROM rate_counts"
T["seg_p"] = (
    "SELECT doc_id, seg_id, words, feature, rate, q05, q95, lo, hi, ref.rn, least(1.0::DOUBLE, 2.0::DOUBLE * least((upto + 1)::DOUBLE / (ref.rn + 1), (from_ + 1)::DOUBLE / (ref.rn + 1))) AS p "
    "FROM seg_feats JOIN rate_ranks USING (feature, rate) JOIN ref USING (feature)"
)


def drawn(r: str, k: str) -> str:
    return f"('0x' || substr(md5('0:' || {r} || ':' || {k}), 1, 8))::BIGINT"


T["sim_docs"] = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM profile WHERE tokens > 0)"
T["sim_segs"] = "SELECT doc_id, seg_id::BIGINT AS seg_id, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY seg_id) - 1 AS j, count(*) OVER (PARTITION BY doc_id) AS m FROM (SELECT DISTINCT doc_id, seg_id, tokens FROM profile WHERE tokens > 0)"
#: Walks of the replicas over the segments of the documents that they pick, until they have so many words.
T["walk_1000"] = (
    f"SELECT r, doc_id, 0 AS k, -1::BIGINT AS seg_id, 0::BIGINT AS held FROM range(2000) t(r) JOIN sim_docs ON i = {drawn('r', '0')} % n UNION ALL "
    f"SELECT w.r, w.doc_id, w.k + 1, s.seg_id, w.held + s.tokens FROM walk_1000 w JOIN sim_segs s ON s.doc_id = w.doc_id AND s.j = {drawn('w.r', '(w.k + 1)')} % s.m WHERE w.held < 1000"
)
T["sim_rates"] = "SELECT r, feature, 1000.0::DOUBLE * sum(n) / max(total) AS rate FROM (SELECT *, max(held) OVER (PARTITION BY r) AS total FROM walk_1000) w JOIN profile p ON p.doc_id = w.doc_id AND p.seg_id = w.seg_id WHERE k > 0 GROUP BY r, feature"


def pair_tables(pair: str) -> None:
    other = "SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM human)" if pair == "quality" else "SELECT text FROM conversations WHERE role = 'assistant'"
    split = f"unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token"
    T[f"vocab_{pair}"] = f"SELECT token, sum(o)::BIGINT AS n_obs, sum(1 - o)::BIGINT AS n_perf FROM (SELECT {split}, 1 AS o FROM documents UNION ALL SELECT {split}, 0 AS o FROM ({other})) GROUP BY token"
    T[f"model_{pair}"] = (
        f"SELECT token, n_obs, n_perf, ln((n_obs + 1.0::DOUBLE) / (t_o + v)) AS lp_obs, ln((n_perf + 1.0::DOUBLE) / (t_p + v)) AS lp_perf "
        f"FROM vocab_{pair}, (SELECT count(*) AS v, sum(n_obs)::BIGINT AS t_o, sum(n_perf)::BIGINT AS t_p FROM vocab_{pair})"
    )
    T[f"scores_{pair}"] = (
        f"SELECT s.*, lp_obs, lp_perf, lp_perf - lp_obs AS delta, xent, is_content AND lp_perf IS NOT NULL AS valid, {CLASS} AS class "
        f"FROM score_toks s LEFT JOIN model_{pair} m ON s.token = m.token, (SELECT -sum(exp(lp_obs) * lp_perf) AS xent FROM model_{pair})"
    )
    T[f"limits_{pair}"] = f"SELECT doc_id, quantile_cont(delta, 0.9) AS lim FROM scores_{pair} WHERE valid GROUP BY doc_id"
    T[f"hot_{pair}"] = f"SELECT s.*, coalesce(valid AND delta > lim + 1e-9::DOUBLE, false) AS hot FROM scores_{pair} s LEFT JOIN limits_{pair} USING (doc_id)"
    b = "-avg(lp_perf) / greatest(avg(xent), 1e-6::DOUBLE)"
    T[f"docs_{pair}"] = f"SELECT '{pair}' AS pair, doc_id, count(*) AS tokens, {b} AS b, avg(delta) AS delta_mean, quantile_cont(delta, 0.1) AS delta_q10, quantile_cont(delta, 0.5) AS delta_q50, quantile_cont(delta, 0.9) AS delta_q90 FROM hot_{pair} WHERE valid GROUP BY doc_id"
    T[f"us_{pair}"] = f"SELECT '{pair}' AS pair, doc_id, unit_id, line, text, n, b, delta_mean, hot_share FROM (SELECT doc_id, unit_id, count(*) AS n, {b} AS b, avg(delta) AS delta_mean, avg(hot::INT) AS hot_share FROM hot_{pair} JOIN (SELECT doc_id, unit_id, unnest(sents) AS sent FROM units_fit) USING (doc_id, sent) WHERE valid GROUP BY doc_id, unit_id HAVING count(*) >= 5) JOIN units_fit USING (doc_id, unit_id)"


FUNCTION = "a an the this that these those of in to for with on at by from as and or but if its it he she they we you i his her their our is are was were be been not".split()
TRANSITION = (
    "however moreover furthermore additionally thus therefore hence consequently nevertheless nonetheless meanwhile specifically notably importantly "
    "interestingly overall finally indeed instead accordingly similarly conversely first second third ultimately crucially"
).split()
CLASS = (
    f"CASE WHEN s.token IN {names(TRANSITION)} THEN 'transition' WHEN s.token IN {names(FUNCTION)} THEN 'function' WHEN regexp_matches(s.token, '^[0-9]') THEN 'number' "
    r"WHEN regexp_matches(s.token, '^[.,;:!?]$') THEN 'punctuation' WHEN regexp_matches(s.token, '^[a-z]+ly$') THEN 'adverb' WHEN regexp_matches(s.token, '^\p{L}') THEN 'word' ELSE 'symbol' END"
)
pair_tables("quality")
pair_tables("assistant")
T["pair_docs"] = "SELECT * FROM docs_quality UNION ALL SELECT * FROM docs_assistant"
T["pair_units"] = "SELECT * FROM us_quality UNION ALL SELECT * FROM us_assistant"
T["bands"] = (
    "SELECT * FROM (SELECT pair, quantile_cont(b, [0.05, 0.5, 0.95]) AS b, quantile_cont(delta_mean, [0.05, 0.5, 0.95]) AS delta, count(*) AS n_docs FROM pair_docs WHERE doc_id IN (SELECT doc_id FROM human) GROUP BY pair) "
    "JOIN (SELECT pair, quantile_cont(b, [0.01, 0.05, 0.5]) AS unit_b, quantile_cont(delta_mean, [0.5, 0.95, 0.99]) AS unit_delta, count(*) AS n_units FROM pair_units WHERE doc_id IN (SELECT doc_id FROM human) GROUP BY pair) USING (pair)"
)
T["slices"] = "SELECT category, slice, total, (sum(total) OVER w)::BIGINT AS stop, (sum(total) OVER w)::BIGINT - total AS start FROM (SELECT source AS category, lang AS slice, count(*) AS total FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY category ORDER BY slice ROWS UNBOUNDED PRECEDING)"
T["draws"] = (
    "SELECT category, o AS \"offset\", draw, slice, o - start AS place FROM (SELECT category, slice, start, o, row_number() OVER (PARTITION BY category ORDER BY md5('20260610:' || category || ':' || o::VARCHAR)) AS draw "
    "FROM (SELECT category, slice, start, unnest(range(start, stop)) AS o FROM slices)) WHERE draw <= 48"
)
T["sampled"] = (
    "SELECT * EXCLUDE (r, k), CASE WHEN r IS NULL AND k > 6 THEN 'quota' ELSE r END AS reason, (CASE WHEN r IS NULL AND k > 6 THEN 'quota' ELSE r END) IS NULL AS accepted FROM "
    "(SELECT *, count(*) FILTER (WHERE r IS NULL) OVER (PARTITION BY category ORDER BY draw ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN slice <> 'en' THEN 'primary' WHEN place % 3 = 0 THEN 'unpublished' END AS r FROM draws))"
)
T["turns"] = r"SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


T["sent_words"] = "SELECT doc_id, para_id, sent_id, unnest(range(len(l))) AS i, unnest(l) AS word FROM (SELECT doc_id, para_id, sent_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)*') AS l FROM sents)"


def _plain() -> str:
    """Visible text of a page's html."""
    c = "regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>|<nav\\b.*?</nav>|<!--.*?-->', ' ', 'g')"
    c = f"regexp_replace({c}, '(?i)</(?:p|div|li|h[1-6]|tr|article|section)>|<br ?/?>', chr(10), 'g')"
    c = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\'\'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


PLAIN = _plain()


def parsed(source: str) -> str:
    """The markdown parser in windows over lines: fences, headings, blank lines."""
    return (
        rf"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS para_id, min(line)::INT AS start_line, max(line)::INT AS end_line, string_agg(t, ' ' ORDER BY line) AS text FROM ("
        rf"SELECT *, sum((t = '')::INT) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM (SELECT doc_id, line, {strip('c')} AS t FROM ("
        rf"SELECT doc_id, line, {cleaned('text')} AS c FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY line) AS fs FROM (SELECT *, starts_with(ltrim(text), '```')::INT AS f FROM "
        rf"(SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {source})))) WHERE f = 0 AND fs % 2 = 0) "
        rf"WHERE NOT regexp_matches(c, '^\s*#{{1,6}}\s'))) WHERE t <> '' GROUP BY doc_id, p"
    )


T["tex_lines"] = (
    "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split('Head matter.' || chr(10) || '\\begin{document}' || chr(10) || string_agg("
    "CASE line % 6 WHEN 0 THEN text || ' % note' WHEN 1 THEN '\\emph{' || text || '} \\cite{key} 5\\% left' WHEN 2 THEN '\\begin{equation}' || chr(10) || text || chr(10) || '\\end{equation}' "
    "WHEN 3 THEN chr(10) || text WHEN 4 THEN '$x + 1$ ' || text || ' \\label{a}' ELSE '\\noindent\\textbf[b]{Bold} ' || text END, chr(10) ORDER BY line) || chr(10) || '\\end{document}', chr(10)) AS l FROM lines GROUP BY doc_id)"
)


def tex_cleaned(c: str) -> str:
    c = rf"regexp_replace({c}, '(^|[^\\])%.*', '\1')"
    c = rf"regexp_replace({c}, '\$\$?[^$]*\$\$?', '{A}', 'g')"
    c = rf"regexp_replace({c}, '\\(?:cite[pt]?|eqref|ref|autoref|label)\*?\{{[^}}]*\}}', '{A}', 'g')"
    c = rf"regexp_replace({c}, '\\(?:begin|end)\{{[^}}]*\}}', '', 'g')"
    c = rf"regexp_replace({c}, '\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{{([^{{}}]*)\}}', '\1', 'g')"
    return rf"regexp_replace({c}, '\\[a-zA-Z]+\*?', '', 'g')"


ENVIRONMENTS = "equation|align|gather|eqnarray|multline|algorithm|algorithmic|figure|table|tabular|array"
T["tex_state"] = (
    rf"SELECT doc_id, line, text, sum(b - e) OVER w AS depth, e FROM (SELECT *, len(regexp_extract_all(text, '\\begin\{{(?:{ENVIRONMENTS})')) AS b, len(regexp_extract_all(text, '\\end\{{(?:{ENVIRONMENTS})')) AS e, "
    r"min(CASE WHEN contains(text, '\begin{document}') THEN line END) OVER (PARTITION BY doc_id) AS opening FROM tex_lines) WHERE opening IS NULL OR line > opening WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING)"
)
TEX_PIECE = f"CASE WHEN depth > 0 OR depth + e > 0 THEN '{A}' ELSE {tex_cleaned('text')} END"
T["tex_pieces"] = (
    "SELECT doc_id, line, depth > 0 OR depth + e > 0 AS math, piece, sum((piece = '')::INT) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS p FROM "
    f"(SELECT *, {strip(TEX_PIECE)} AS piece FROM tex_state)"
)
T["tex_paras"] = (
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS para_id, start_line::INT AS start_line, max(end_line)::INT AS end_line, string_agg(piece, ' ' ORDER BY line) AS text FROM "
    "(SELECT *, min(CASE WHEN NOT math THEN line END) OVER g AS start_line, max(CASE WHEN NOT math THEN line END) OVER g AS end_line FROM tex_pieces WHERE piece <> '' WINDOW g AS (PARTITION BY doc_id, p)) "
    "WHERE start_line IS NOT NULL AND line >= start_line GROUP BY doc_id, p, start_line"
)
_features()
Q: dict[str, str] = {
    "lines": "SELECT doc_id, line, text FROM lines",
    "paragraphs": parsed("documents"),
    "paragraphs_line": "SELECT * FROM paras",
    "tex_paragraphs": "SELECT * FROM tex_paras",
    "conversation_paragraphs": f"SELECT doc_id, para_id, start_line, end_line, {words('text')} AS words FROM ({parsed('turns')})",
    "prose_text": "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY para_id) AS text FROM paras GROUP BY doc_id",
    "sentences": "SELECT doc_id, para_id, line, sent_id, text, n_words FROM sents",
    "segments": "SELECT doc_id, seg_id, start_line, end_line, words FROM segs",
    "segments_1000": "SELECT doc_id, g AS seg_id, min(start_line) AS start_line, max(end_line) AS end_line, sum(words)::BIGINT AS words FROM para_words JOIN seg_groups_1000 USING (doc_id, i) GROUP BY doc_id, g",
    "scored_sentences": "SELECT * FROM scored",
    "units": "SELECT doc_id, unit_id, line, n_sents, words, text FROM units",
    "scored_tokens": "SELECT * FROM score_toks",
    "token_chunks": f"SELECT doc_id, c::INT AS chunk, (c * 350)::INT AS start, least(c * 350 + 400, n)::INT AS stop, CASE WHEN c = 0 THEN 1 ELSE 50 END AS score_from FROM (SELECT doc_id, n, unnest(range(0, greatest(0, ceil((n - 400) / 350.0))::INT + 1)) AS c FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '{TOKEN}')) AS n FROM documents) WHERE n > 0)",
    "document_counts": f"SELECT doc_id, paragraphs, words, coalesce(s, 0) AS sentences FROM (SELECT doc_id, count(*) AS paragraphs, sum({words('text')})::BIGINT AS words FROM paras GROUP BY doc_id) LEFT JOIN (SELECT doc_id, count(*) AS s FROM sents GROUP BY doc_id) USING (doc_id)",
    "sentence_cv": "SELECT doc_id, sentences, round(cv, 6) AS cv FROM scv",
    "paragraph_cv": "SELECT doc_id, paragraphs, round(cv, 6) AS cv FROM pcv",
    "generic_paragraphs": "SELECT * FROM generic",
    "heuristic_findings": "SELECT doc_id, line, 0 AS span_start, 0 AS span_end, 'heuristic' AS layer, rule, severity::DOUBLE AS severity, match FROM heur",
    "excess_vocabulary": "SELECT word, n_in, n_out, round(ratio, 6) AS ratio FROM excess",
    "lexical_findings": "SELECT * FROM found WHERE layer = 'lexical'",
    "lexical_density": "SELECT doc_id, words, round(1000.0::DOUBLE * coalesce(s, 0) / greatest(1, words), 6) AS strong_per_1k, round(1000.0::DOUBLE * coalesce(n, 0) / greatest(1, words), 6) AS all_per_1k FROM doc_words LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE severity >= 0.6) AS s, count(*) AS n FROM found WHERE layer = 'lexical' GROUP BY doc_id) USING (doc_id)",
    "feature_counts": "SELECT doc_id, feature, n, tokens, round(rate, 6) AS rate FROM feats",
    "word_shape": rf"SELECT doc_id, round(len(list_distinct(w[1:400]))::DOUBLE / len(w[1:400]), 6) AS f_43_type_token, round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 6) AS f_44_mean_word_length FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{TOKEN}'), lambda x: regexp_matches(x, '^[\p{{L}}\p{{N}}]')) AS w FROM documents) WHERE len(w) > 0",
    "doc_bands": bands_of("human_feats", "feature", "rate", 6),
    "segment_bands": bands_of("profile", "feature", "rate", 6),
    "metric_bands": "SELECT * FROM (" + bands_of("(SELECT 'sentence_cv' AS metric, doc_id, round(cv, 3) AS value FROM scv UNION ALL SELECT 'paragraph_cv', doc_id, round(cv, 3) FROM pcv UNION ALL SELECT 'strong_per_1k', doc_id, strong FROM dense UNION ALL SELECT 'all_per_1k', doc_id, every FROM dense) x WHERE doc_id IN (SELECT doc_id FROM human)", "metric", "value", 3).replace("round(list_sort", "round(list_sort") + ") WHERE n >= 3",
    "corpus_admission": "SELECT doc_id, words, words >= 300 AS kept FROM doc_words",
    "out_of_band": "SELECT doc_id, feature, round(rate, 6) AS rate, side, round(sigma, 6) AS sigma, key, round(least(0.55::DOUBLE + 0.06::DOUBLE * sigma + CASE WHEN key THEN 0.1::DOUBLE ELSE 0 END, 0.95::DOUBLE), 2) AS severity FROM deviating",
    "top_features": "SELECT doc_id, feature, round(rate, 6) AS rate, side, round(sigma, 6) AS sigma, key, rank, round(least(0.55::DOUBLE + 0.06::DOUBLE * sigma + CASE WHEN key THEN 0.1::DOUBLE ELSE 0 END, 0.95::DOUBLE), 2) AS severity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sigma DESC, feature) AS rank FROM deviating) WHERE rank <= 12",
    "segment_p_values": "SELECT doc_id, seg_id, feature, round(rate, 6) AS rate, round(p, 6) AS p FROM seg_p",
    "segment_scan": (
        f"SELECT doc_id, feature, round(min(p), 6) AS p, round(greatest(max(greatest((rate - hi) / span, (lo - rate) / span)), 0.0::DOUBLE), 6) AS beyond, string_agg(CASE WHEN rate > q95 THEN '↑' WHEN rate < q05 THEN '↓' ELSE '·' END, '' ORDER BY seg_id) AS map, "
        "array_to_string(list(seg_id ORDER BY p, seg_id)[1:3], ',') AS worst, count(*) AS segments, round(sum(rate * words) / sum(words), 6) AS doc_rate, "
        "sum(rate * words) / sum(words) >= first(q05) AND sum(rate * words) / sum(words) <= first(q95) AS in_band, min(p) <= 2.0::DOUBLE / (first(rn) + 1) + 1e-12::DOUBLE AS at_floor, round(least(0.6::DOUBLE + 0.15::DOUBLE * greatest(0.0::DOUBLE, -log10(min(p)) - 1), 0.9::DOUBLE), 2) AS severity "
        f"FROM (SELECT *, greatest(hi - lo, 1e-9::DOUBLE) AS span, count(*) OVER (PARTITION BY doc_id, feature) AS k FROM seg_p WHERE words >= {TAIL}) WHERE k >= 4 GROUP BY doc_id, feature HAVING max((rate > q95 OR rate < q05)::INT) > 0 AND min(p) < 0.05"
    ),
    "word_model": "SELECT token, n_obs, n_perf, round(lp_obs, 6) AS lp_obs, round(lp_perf, 6) AS lp_perf FROM model_assistant",
    "document_scores": "SELECT pair, doc_id, tokens, round(b, 6) AS b, round(delta_mean, 6) AS delta_mean, round(delta_q10, 6) AS delta_q10, round(delta_q50, 6) AS delta_q50, round(delta_q90, 6) AS delta_q90 FROM pair_docs",
    "hot_burstiness": "SELECT doc_id, count(*) AS n_hot, round(CASE WHEN count(*) < 3 OR stddev_pop(gap) + avg(gap) <= 0 THEN 0 ELSE (stddev_pop(gap) - avg(gap)) / (stddev_pop(gap) + avg(gap)) END, 6) AS burstiness FROM (SELECT doc_id, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM hot_assistant WHERE hot) GROUP BY doc_id",
    "hot_window": "SELECT doc_id, round(CASE WHEN count(*) > 50 THEN max(r) / 50.0::DOUBLE ELSE 0 END, 6) AS hot_window FROM (SELECT doc_id, sum(hot::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS r FROM hot_assistant) GROUP BY doc_id",
    "token_classes": "SELECT doc_id, class, count(*) AS n, round(avg(delta), 6) AS delta_mean, round(quantile_cont(delta, 0.9), 6) AS delta_q90, round(avg(hot::INT), 6) AS hot_share, round(-avg(lp_perf), 6) AS logppl_perf FROM hot_assistant WHERE lp_perf IS NOT NULL GROUP BY doc_id, class HAVING count(*) >= 10",
    "unit_scores": "SELECT pair, doc_id, unit_id, line, text, n, round(b, 6) AS b, round(delta_mean, 6) AS delta_mean, round(hot_share, 6) AS hot_share FROM pair_units",
    "calibration_bands": "SELECT pair, n_docs, n_units, " + ", ".join(f"round({c}[{i + 1}], 6) AS {c}_{q}" for c, qs in (("b", "p05 p50 p95"), ("delta", "p05 p50 p95"), ("unit_b", "p01 p05 p50"), ("unit_delta", "p50 p95 p99")) for i, q in enumerate(qs.split())) + " FROM bands",
    "document_verdicts": "SELECT d.pair, doc_id, d.b < s.b[1] - 1e-9::DOUBLE AS below, delta_mean > s.delta[3] + 1e-9::DOUBLE AS above, (CASE WHEN d.b < s.b[1] - 1e-9::DOUBLE THEN 0.7 ELSE 0.3 END)::DOUBLE AS severity FROM pair_docs d JOIN bands s USING (pair)",
    "unit_flags": "SELECT pair, doc_id, unit_id, line, substr(text, 1, 90) AS match, CASE WHEN b < ub[2] - 1e-9::DOUBLE THEN 'machine_like' ELSE 'performer_tilt' END AS rule, (CASE WHEN b < ub[2] - 1e-9::DOUBLE THEN CASE WHEN b < ub[1] - 1e-9::DOUBLE THEN 0.8 ELSE 0.65 END ELSE CASE WHEN delta_mean > ud[3] + 1e-9::DOUBLE THEN 0.75 ELSE 0.6 END END)::DOUBLE AS severity FROM (SELECT u.*, s.unit_b AS ub, s.unit_delta AS ud FROM pair_units u JOIN bands s USING (pair)) WHERE b < ub[2] - 1e-9::DOUBLE OR delta_mean > ud[2] + 1e-9::DOUBLE",
    "flagged_units": "SELECT pair, doc_id, unit_id, round(b, 6) AS b, round(delta_mean, 6) AS delta_mean, rank, flagged, round(flagged / total, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY pair, doc_id ORDER BY b, unit_id) AS rank FROM (SELECT u.*, count(*) FILTER (WHERE f) OVER (PARTITION BY pair, doc_id) AS flagged, count(*) OVER (PARTITION BY pair, doc_id) AS total FROM (SELECT u.*, u.b < s.unit_b[2] - 1e-9::DOUBLE OR delta_mean > s.unit_delta[2] + 1e-9::DOUBLE AS f FROM pair_units u JOIN bands s USING (pair)) u) WHERE f) WHERE rank <= 3",
    "consensus": "SELECT doc_id, unit_id, round(mr, 6) AS mean_rank, round(mb, 6) AS min_b, votes, pairs, row_number() OVER (PARTITION BY doc_id ORDER BY mr, unit_id) AS place FROM (SELECT doc_id, unit_id, avg(r) AS mr, min(b) AS mb, count(*) FILTER (WHERE delta_mean > 0) AS votes, count(*) AS pairs FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id, pair ORDER BY b, unit_id) - 1)::DOUBLE / greatest(1, count(*) OVER (PARTITION BY doc_id, pair) - 1) AS r FROM pair_units) GROUP BY doc_id, unit_id)",
    "untested_axes": "SELECT DISTINCT doc_id, 0 AS line, 0 AS span_start, 0 AS span_end, 'statistical' AS layer, 'untested_axes' AS rule, 0.3::DOUBLE AS severity, '' AS match FROM documents",
    "page_text": rf"SELECT doc_id, length(t) AS chars, {words('t')} AS words FROM (SELECT page_id AS doc_id, regexp_replace({PLAIN}, '[ \t]+', ' ', 'g') AS t FROM pages)",
    "trigram_hits": "SELECT doc_id, trigram, count(*) AS n FROM (SELECT DISTINCT a.doc_id, a.para_id, a.sent_id, a.i, trigram FROM sent_words a JOIN (VALUES ('of the and', 'of', 'the', 'and'), ('the in of', 'the', 'in', 'of'), ('is the of', 'is', 'the', 'of'), ('to and that', 'to', 'and', 'that')) r(trigram, x, y, z) ON a.word = x JOIN sent_words b ON b.doc_id = a.doc_id AND b.para_id = a.para_id AND b.sent_id = a.sent_id AND b.word = y AND b.i BETWEEN a.i + 1 AND a.i + 3 JOIN sent_words c ON c.doc_id = a.doc_id AND c.para_id = a.para_id AND c.sent_id = a.sent_id AND c.word = z AND c.i BETWEEN b.i + 1 AND b.i + 3) GROUP BY ALL",
    "findings_per_1k": "SELECT doc_id, words, coalesce(n, 0) AS findings, coalesce(s, 0) AS strong, round(1000.0::DOUBLE * coalesce(n, 0) / greatest(1, words), 6) AS per_1k, round(1000.0::DOUBLE * coalesce(s, 0) / greatest(1, words), 6) AS strong_per_1k FROM doc_words LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE severity >= 0.6) AS s FROM found GROUP BY doc_id) USING (doc_id)",
    "recurring_rules": "SELECT doc_id, rule, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rule) AS r FROM (SELECT doc_id, rule, count(*) AS n FROM found WHERE line > 0 GROUP BY ALL HAVING count(*) >= 3)) WHERE r <= 10",
    "worklist": "SELECT *, CASE WHEN severity >= 0.9 THEN 'ERR' WHEN severity >= 0.6 THEN 'WARN' ELSE 'sugg' END AS label FROM merged WHERE line > 0",
    "mended_lines": "SELECT doc_id, line, text, regexp_replace(t, ' {2,}', ' ', 'g') AS fixed, n AS n_edits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY i DESC) AS last FROM mend_walk) WHERE last = 1",
    "reports": "SELECT doc_id, '{\"meta\":' || m || ',\"findings\":[' || coalesce(f, '') || ']}' AS report FROM report_meta LEFT JOIN (SELECT doc_id, string_agg(j, ',' ORDER BY line, span_start, rule, j) AS f FROM report_rows GROUP BY doc_id) USING (doc_id)",
    "findings_merged": "SELECT * FROM merged",
    "simulated_bands": "SELECT feature, round(quantile_cont(rate, 0.05), 6) AS p05, round(quantile_cont(rate, 0.5), 6) AS p50, round(quantile_cont(rate, 0.95), 6) AS p95, round(stddev_pop(rate), 6) AS sd FROM sim_rates GROUP BY feature",
    "sample_slices": "SELECT * FROM slices",
    "sample_draws": "SELECT * FROM draws",
    "sample_accepted": "SELECT * FROM sampled",
    "sample_manifest": "SELECT category, count(*) AS draws, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE reason = 'primary') AS wrong_primary, count(*) FILTER (WHERE reason = 'unpublished') AS unpublished FROM sampled GROUP BY category",
}


def _needed(sql: str) -> list[str]:
    """Common tables that a query reads, each after those that it reads itself."""
    out: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in T:
            if name != own and name not in out and re.search(rf"\b(?:FROM|JOIN)\s+\(*{name}\b|, {name}\b(?! [aA][sS])", text):
                visit(T[name], name)
                if name not in out:
                    out.append(name)

    visit(sql)
    return out


def sql(name: str) -> str:
    tables = _needed(Q[name])
    if not tables:
        return Q[name]
    kept = {"sents", "scored", "fit", "score_toks", "doc_toks", "seg_toks"}
    return "WITH RECURSIVE " + ",\n".join(f"{t} AS {'MATERIALIZED ' if t in kept else ''}({T[t]})" for t in tables) + "\n" + Q[name]


def oracle_sql() -> dict[str, str]:
    return {name: sql(name) for name in Q}
