"""The same results in the SQL of a single-node engine, written independently of the Spark forms."""

from __future__ import annotations

import re

from notesift.functions import constants as C
from notesift.operators import generator
from notesift.plans.carrier import SQL

NOTES = f"notes AS ({SQL})"
#: Unicode's white space, spelt out for an engine whose \s is ASCII.
WS = r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fi(source: str, pattern: str, label: str, ord_: int, group: str | None = None) -> str:
    """Matches with offsets: marked by a sentinel, split, and placed by a running sum."""
    whole, kept = (f"({pattern})({group})", r"'\1' || chr(1) || '\2' || chr(1)") if group else (f"({pattern})", r"chr(1) || '\1' || chr(1)")
    return f"""SELECT doc_id, piece AS text, {q(label)} AS label, s AS "start", (s + length(piece))::INT AS "end", {ord_} AS ord FROM (
      SELECT doc_id, i, piece, COALESCE(SUM(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS s FROM (
        SELECT doc_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i FROM (
          SELECT doc_id, string_split(regexp_replace(text, {q(whole)}, {kept}, 'g'), chr(1)) AS parts FROM {source}))) WHERE i % 2 = 0"""


def terms(source: str, words: list[str], label: str, ord_: int) -> str:
    """Each term by itself, in any case: pieces between its occurrences give the places."""
    values = ", ".join(f"({q(w)})" for w in words)
    return f"""SELECT doc_id, substr(text, s + 1, length(w)) AS text, {q(label)} AS label, s AS "start", (s + length(w))::INT AS "end", {ord_} AS ord FROM (
      SELECT doc_id, text, w, (SUM(length(piece) + length(w)) OVER (PARTITION BY doc_id, w ORDER BY i) - length(w))::INT AS s, i, n FROM (
        SELECT doc_id, text, w, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM (
          SELECT doc_id, text, w, string_split(lower(text), lower(w)) AS parts FROM {source}, (VALUES {values}) t(w) WHERE contains(lower(text), lower(w))))) WHERE i < n"""


def abbreviations(source: str) -> str:
    """Each key by itself; neighbours that are letters rule a match out."""
    keys = sorted(C.ABBREVIATIONS, key=len, reverse=True)
    values = ", ".join(f"({q(k)}, {q(C.ABBREVIATIONS[k])}, {n})" for n, k in enumerate(keys))
    return f"""SELECT doc_id, w AS text, meaning AS label, s AS "start", (s + length(w))::INT AS "end", ord FROM (
      SELECT doc_id, text, w, meaning, ord, (SUM(length(piece) + length(w)) OVER (PARTITION BY doc_id, w ORDER BY i) - length(w))::INT AS s, i, n FROM (
        SELECT doc_id, text, w, meaning, ord, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i, len(parts) AS n FROM (
          SELECT doc_id, text, w, meaning, ord, string_split(text, w) AS parts FROM {source}, (VALUES {values}) t(w, meaning, ord) WHERE contains(text, w))))
      WHERE i < n AND NOT regexp_matches(substr(text, s, 1), '^[A-Za-z]') AND NOT regexp_matches(substr(text, s + length(w) + 1, 1), '^[A-Za-z]')"""


def fold(source: str, better: str = 'y[1]."end" - y[1]."start" > acc[-1]."end" - acc[-1]."start"', fields: str = 'text, label, "start", "end", ord') -> str:
    """Left to right, what overlaps the last span replaces it if it is better."""
    struct = ", ".join(f"{f} := {f}" for f in fields.split(", "))
    out = ", ".join(f"x.{f} AS {f}" for f in fields.split(", "))
    return f"""SELECT doc_id, {out} FROM (SELECT doc_id, unnest(list_reduce(list_transform(spans, lambda x: [x]),
      lambda acc, y: CASE WHEN y[1]."start" >= acc[-1]."end" THEN acc || y WHEN {better} THEN acc[:-2] || y ELSE acc END)) AS x
      FROM (SELECT doc_id, list(struct_pack({struct}) ORDER BY "start", -"end", ord) AS spans FROM {source} GROUP BY doc_id))"""


def spliced(source: str, spans: str, replacement: str) -> str:
    """Right to left, each span replaced in what the ones after it have left."""
    return f"""SELECT n.doc_id, CASE WHEN r.l IS NULL THEN n.text ELSE list_reduce([struct_pack(t := n.text, s := 0, e := 0, r := '')] || r.l,
      lambda acc, x: struct_pack(t := left(acc.t, x.s) || x.r || substr(acc.t, x.e + 1), s := x.s, e := x.e, r := x.r)).t END AS text
      FROM {source} n LEFT JOIN (SELECT doc_id, list(struct_pack(t := '', s := "start"::INT, e := "end"::INT, r := {replacement}) ORDER BY "start" DESC, ord) AS l FROM {spans} GROUP BY doc_id) r ON n.doc_id = r.doc_id"""


# -- cleaning ---------------------------------------------------------------
def _replace(t: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({t}, {q(pattern)}, {by}, 'g')"


def encoding(t: str) -> str:
    return f"replace(nfc_normalize({t}), '﻿', '')"


def controls(t: str) -> str:
    return _replace(t, r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]")


def artifacts(t: str) -> str:
    for p in C.ARTIFACTS:
        t = _replace(t, p.replace(r"\s", WS))
    return t


def whitespace(t: str) -> str:
    t = _replace(f"replace({t}, chr(9), ' ')", " {2,}", "' '")
    return _replace(_replace(t, r"\n{3,}", "chr(10) || chr(10)"), r" +\n", "chr(10)")


def punctuation(t: str) -> str:
    return f"replace(translate({t}, '‘’“”–—', '''''\"\"--'), '…', '...')"


def strip(t: str) -> str:
    return _replace(t, f"^{WS}+|{WS}+$")


def cleaned(t: str) -> str:
    for step in (encoding, controls, artifacts, whitespace, punctuation, strip):
        t = step(t)
    return t


# -- common table expressions, each over a source with doc_id and text ---------
def phi(name: str, source: str) -> str:
    each = [fi(source, p, kind, k) for k, (kind, p) in enumerate(C.PHI.items())] + [fi(source, C.NAME[0], "NAME", len(C.PHI), C.NAME[1])]
    return f"{name}_all AS ({' UNION ALL '.join(each)}), {name} AS ({fold(name + '_all')})"


def rules(name: str, source: str) -> str:
    each = [fi(source, "(?i)" + C.DOSAGE, "DOSAGE", 0), fi(source, C.DATE, "DATE", 1), terms(source, C.MEDICATIONS, "MEDICATION", 2), terms(source, C.DIAGNOSES, "DIAGNOSIS", 3)]
    return f"{name}_all AS ({' UNION ALL '.join(each)}), {name} AS ({fold(name + '_all')})"


def sections(name: str, source: str) -> str:
    each = []
    for k, (label, patterns) in enumerate(C.SECTIONS.items()):
        each.append(fi(source, r"(?im)^\s*(?:" + "|".join(patterns) + r")\s*:?\s*$", label, k))
    return f"""{name}_all AS ({" UNION ALL ".join(each)}),
      {name}_next AS (SELECT h.doc_id, label, "start", "end" AS header_end, ord, LEAD("start") OVER (PARTITION BY h.doc_id ORDER BY "start", ord) AS nxt FROM {name}_all h),
      {name} AS (SELECT h.doc_id, (row_number() OVER (PARTITION BY h.doc_id ORDER BY "start", ord) - 1)::INT AS ord, label AS name, "start", COALESCE(nxt, length(n.text))::INT AS "end",
        {strip("substr(n.text, header_end + 1, greatest(COALESCE(nxt, length(n.text)) - header_end, 0))")} AS text FROM {name}_next h JOIN {source} n ON h.doc_id = n.doc_id)"""


def lines(name: str, source: str) -> str:
    protected = "text"
    for w in C.PROTECTED:
        protected = f"replace({protected}, {q(w)}, {q(w.replace('.', chr(2)))})"
    kind = f"CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, {q(C.HEADER_LINE)}) THEN 'header' WHEN regexp_matches(line, {q(C.LIST_LINE)}) THEN 'list' WHEN regexp_matches(line, {q(C.VITALS_LINE)}) THEN 'vitals' ELSE 'prose' END"
    return f"""{name} AS (SELECT doc_id, i, line, {kind} AS kind FROM (SELECT doc_id, {strip("l")} AS line, i FROM (
      SELECT doc_id, unnest(p) AS l, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split({protected}, chr(10)) AS p FROM {source}))))"""


def sentences(name: str, source: str) -> str:
    return f"""{lines(name + "_l", source)},
      {name}_g AS (SELECT *, SUM(CASE WHEN kind = 'prose' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM {name}_l),
      {name}_u AS (SELECT doc_id, min(i) AS i, string_agg({_replace("line", r"([.!?])" + WS + r"+([A-Z])", r"'\1 \2'")}, ' ' ORDER BY i) AS s FROM {name}_g WHERE kind = 'prose' GROUP BY doc_id, g
        UNION ALL SELECT doc_id, i, line FROM {name}_g WHERE kind NOT IN ('prose', 'blank')),
      {name} AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ord, sentence FROM (SELECT doc_id, i, {strip("replace(s, chr(2), '.')")} AS sentence FROM {name}_u) WHERE sentence <> '')"""


def negated(name: str, source: str, spans: str) -> str:
    before = f"""string_split({_replace(strip('lower(substr(n.text, greatest(e."start" - 150, 0) + 1, e."start" - greatest(e."start" - 150, 0)))'), WS + "+", "' '")}, ' ')"""
    after = f"""string_split({_replace(strip('lower(substr(n.text, e."end" + 1, 150))'), WS + "+", "' '")}, ' ')"""
    hit = lambda triggers, w: f"(list_filter([{', '.join(q(t) for t in sorted(triggers, key=len, reverse=True))}], lambda t: contains({w}, t)))[1]"
    return f"""{name}_w AS (SELECT e.*, array_to_string({before}[-7:], ' ') AS pre, array_to_string({after}[:7], ' ') AS post FROM {spans} e JOIN {source} n ON e.doc_id = n.doc_id),
      {name}_h AS (SELECT *, {hit(C.PRE_TRIGGERS, "pre")} AS a, {hit(C.POST_TRIGGERS, "post")} AS b FROM {name}_w),
      {name} AS (SELECT *, (a IS NOT NULL OR b IS NOT NULL) AS negated, COALESCE(a, b, '') AS trigger, CASE WHEN a IS NOT NULL THEN 'pre' WHEN b IS NOT NULL THEN 'post' ELSE 'none' END AS trigger_type FROM {name}_h)"""


def tokens(name: str, source: str) -> str:
    return f"""{name} AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY "start") - 1)::INT AS pos, text AS token, "start", "end" FROM ({fi(source, "[^" + WS[1:-1] + "]+", "", 0)}))"""


def model(source: str) -> str:
    procedures = ["chest X-ray", "echocardiogram", "colonoscopy", "lumbar puncture", "dialysis"]
    parts = [(C.MEDICATIONS[:12], "MEDICATION", 0, 0.97), (C.DIAGNOSES[:12], "DIAGNOSIS", 1, 0.75), (procedures, "PROCEDURE", 2, 0.5)]
    return " UNION ALL ".join(f"SELECT *, {c}::DOUBLE AS confidence, 'model' AS source FROM ({terms(source, w, label, k)})" for w, label, k, c in parts)


def merged(name: str, source: str) -> str:
    """Rules and model, deduplicated, without overlaps, with negation, section, context and status."""
    kept = 'text, label, "start", "end", ord, confidence, source'
    context = """CASE WHEN e."start" > 40 THEN '...' ELSE '' END || substr(n.text, greatest(e."start" - 40, 0) + 1, least(e."end" + 40, length(n.text)) - greatest(e."start" - 40, 0)) || CASE WHEN e."end" + 40 < length(n.text) THEN '...' ELSE '' END"""
    return f"""{rules(name + "_r", source)}, {name}_m AS ({model(source)}),
      {name}_u AS (SELECT doc_id, {kept}, 1 AS side FROM {name}_m UNION ALL SELECT doc_id, text, label, "start", "end", ord, 0.8::DOUBLE, 'rules', 0 FROM {name}_r),
      {name}_d AS (SELECT doc_id, {kept} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(text), label, "start", "end" ORDER BY side DESC) AS rn FROM {name}_u) WHERE rn = 1),
      {name}_f AS ({fold(name + "_d", "y[1].confidence > acc[-1].confidence", kept)}),
      {sections(name + "_s", source)}, {negated(name + "_n", source, name + "_f")},
      {name} AS (SELECT e.doc_id, e.text, e.label, e."start", e."end", round(e.confidence, 4) AS confidence, e.negated,
        COALESCE((SELECT arg_min(s.name, s.ord) FROM {name}_s s WHERE s.doc_id = e.doc_id AND s."start" <= e."start" AND e."start" < s."end"), 'Unknown') AS section, e.source, {context} AS context_snippet,
        CASE WHEN e.confidence >= 0.85 THEN 'auto_accepted' WHEN e.confidence >= 0.6 THEN 'flagged' ELSE 'fallback' END AS status FROM {name}_n e JOIN {source} n ON e.doc_id = n.doc_id)"""


# -- generated notes ----------------------------------------------------------
def made() -> str:
    g = generator

    def drawn(purpose: int) -> str:
        return f"((((doc_id::BIGINT % {g.IDS} + {g.IDS}) % {g.IDS} + {purpose * g.APART}) * {g.FACTORS[0]} % {g.PRIME}) * {g.FACTORS[1]} % {g.PRIME})"

    def one_of(values: list, at: str) -> str:
        return f"([{', '.join(q(v) if isinstance(v, str) else str(v) for v in values)}])[({at}) + 1]"

    def piece(p: generator.Piece) -> str:
        text = q(p.text) if p.text is not None else "NULL::VARCHAR"
        if p.pool is not None and not p.label:
            of = lists[p.pool]
            text = one_of(of, f"{drawn(p.purpose)} % {len(of)}")
        elif p.before is not None:
            text = f"{q(p.before)} || ({p.low} + {drawn(p.purpose)} % {p.n})::VARCHAR"
        return f"struct_pack(text := {text}, label := {q(p.label) if p.label else 'NULL::VARCHAR'})"

    def choice(c: generator.Choice) -> str:
        cases = " ".join(f"WHEN {k} THEN [{', '.join(map(piece, v))}]" for k, v in enumerate(c.variants))
        return f"CASE {drawn(c.purpose)} % {len(c.variants)} {cases} END"

    def draw(n: int, size: int) -> str:
        step = one_of(g.steps(size), f"{drawn(2 * n)} % {len(g.steps(size))}")
        return f"(k * {step} + {drawn(2 * n + 1)}) % {size}"

    lists = list(g.LISTS.values())
    cases = " ".join(f"WHEN {k} THEN {' || '.join(map(choice, c))}" for k, c in enumerate(g.notes_compiled().values()))
    kinds = ", ".join(map(q, C.NOTE_TYPES))
    draws = " ".join(f"WHEN {q(label)} THEN {one_of(pool, draw(n, len(pool)))}" for n, (label, pool) in enumerate(C.POOLS.items()))
    return f"""made_p AS (SELECT doc_id, ([{kinds}])[(doc_id % 5 + 1)::INT] AS note_type, CASE doc_id % 5 {cases} END AS p FROM documents),
      made_e AS (SELECT doc_id, note_type, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM made_p),
      made_k AS (SELECT doc_id, note_type, i, x.text AS raw, x.label AS label, row_number() OVER (PARTITION BY doc_id, x.label ORDER BY i) - 1 AS k FROM made_e),
      made_d AS (SELECT doc_id, note_type, i, label, COALESCE(raw, CASE label {draws} END) AS text FROM made_k),
      made_s AS (SELECT doc_id, note_type, i, text, label, COALESCE(SUM(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS "start" FROM made_d),
      made AS (SELECT doc_id, note_type, string_agg(text, '' ORDER BY i) AS text FROM made_s GROUP BY doc_id, note_type),
      gold AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS ord, text, label, "start", ("start" + length(text))::INT AS "end" FROM made_s WHERE label IS NOT NULL)"""


IDS = "(VALUES " + ", ".join(f"({q(t)}, {k})" for t, k in C.TAG_IDS.items()) + ") ids(tag, tag_id)"


def tagged() -> str:
    fits = '(e.es <= t."start" AND t."end" <= e.ee) OR (least(e.ee, t."end") - greatest(e.es, t."start")) * 2 > t."end" - t."start"'
    first = 'CASE WHEN e.es <= t."start" AND t."end" <= e.ee THEN t."start" = e.es ELSE t."start" <= e.es END'
    return f"""{made()}, {tokens("tok", "made")},
      cut AS (SELECT doc_id, ord, label, "start" AS es, "end" - CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS ee FROM gold),
      cand AS (SELECT t.doc_id, t.pos, (CASE WHEN {first} THEN 'B-' ELSE 'I-' END) || e.label AS tag, e.es, e.ord FROM tok t JOIN cut e ON t.doc_id = e.doc_id AND e.es < t."end" AND e.ee > t."start" WHERE {fits}),
      best AS (SELECT doc_id, pos, tag FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY es, ord) AS rn FROM cand) WHERE rn = 1),
      tagged AS (SELECT t.doc_id, t.pos, t.token, t."start", t."end", COALESCE(b.tag, 'O') AS tag, ids.tag_id::INT AS tag_id FROM tok t LEFT JOIN best b ON t.doc_id = b.doc_id AND t.pos = b.pos JOIN {IDS} ON COALESCE(b.tag, 'O') = ids.tag)"""


def subwords() -> str:
    return f"""{tagged()}, sub AS (SELECT doc_id, pos * 2 + 1 AS pos, pos AS word_id FROM tok UNION ALL SELECT doc_id, pos * 2 + 2, pos FROM tok WHERE length(token) > 4
      UNION ALL SELECT doc_id, 0, NULL FROM made UNION ALL SELECT doc_id, 100000, NULL FROM made),
      prev AS (SELECT *, LAG(word_id) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM sub)"""


def pairs() -> str:
    name = lambda c: f"(SELECT tag FROM {IDS} WHERE ids.tag_id = {c})"
    return f"""{tagged()}, pairs AS (SELECT doc_id, pos, token, "start", "end", CASE WHEN k % 29 = 0 THEN -100 ELSE tag_id END AS true_id,
        CASE WHEN k % 7 = 0 THEN 0 WHEN k % 11 = 0 THEN 5 WHEN k % 13 = 0 AND tag_id > 0 THEN (tag_id % 10) + 1 ELSE tag_id END AS pred_id FROM (SELECT *, doc_id * 31 + pos AS k FROM tagged)),
      named AS (SELECT p.*, a.tag AS tt, b.tag AS pt, string_agg(p.token, ' ') OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS context
        FROM pairs p LEFT JOIN {IDS.replace("ids(", "a(")} ON a.tag_id = p.true_id JOIN {IDS.replace("ids(", "b(")} ON b.tag_id = p.pred_id),
      kept AS (SELECT *, CASE WHEN tt = 'O' THEN 'O' ELSE substr(tt, 3) END AS tk, CASE WHEN pt = 'O' THEN 'O' ELSE substr(pt, 3) END AS pk FROM named WHERE true_id <> -100),
      wrong AS (SELECT doc_id, pos, token AS text, tt AS true_label, pt AS pred_label, context, CASE WHEN tt = 'O' THEN 'false_positive' WHEN pt = 'O' THEN 'false_negative' ELSE 'misclassified' END AS error_type FROM kept WHERE tt <> pt)"""


def chunks(name: str, tag: str, kind: str) -> str:
    return f"""{name}_b AS (SELECT doc_id, pos, {kind} AS kind, CASE WHEN {kind} <> 'O' AND ({tag}[1] = 'B' OR {kind} <> LAG({kind}, 1, 'O') OVER (PARTITION BY doc_id ORDER BY pos)) THEN 1 ELSE 0 END AS b FROM kept),
      {name}_g AS (SELECT *, SUM(b) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM {name}_b),
      {name} AS (SELECT doc_id, kind, min(pos) AS s, max(pos) AS e FROM {name}_g WHERE kind <> 'O' GROUP BY doc_id, g, kind)"""


def ratios() -> str:
    p, r = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0::DOUBLE END", "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0::DOUBLE END"
    return f"round({p}, 4) AS precision, round({r}, 4) AS recall, round(CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0::DOUBLE END, 4) AS f1"


def matches() -> str:
    return f"""{pairs()}, {chunks("cg", "tt", "tk")}, {chunks("cp", "pt", "pk")},
      m AS (SELECT COALESCE(cg.kind, cp.kind) AS kind, (cg.s IS NOT NULL AND cp.s IS NOT NULL)::INT AS tp, (cg.s IS NULL)::INT AS fp, (cp.s IS NULL)::INT AS fn
        FROM cg FULL JOIN cp ON cg.doc_id = cp.doc_id AND cg.kind = cp.kind AND cg.s = cp.s AND cg.e = cp.e)"""


def w(*parts: str) -> str:
    """WITH these expressions (all but the last), the last selects."""
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


SPAN = 'SELECT doc_id, text, label, "start", "end" FROM '
SUMS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"


def _pipeline() -> list[str]:
    return [
        NOTES, f"c1 AS (SELECT doc_id, {cleaned('text')} AS text FROM notes)", f"ab AS ({abbreviations('c1')})",
        f"c2 AS ({spliced('c1', 'ab', chr(34) + 'text' + chr(34) + ' || ' + q(' (') + ' || label || ' + q(')'))})", phi("ph", "c2"), f"c3 AS ({spliced('c2', 'ph', q(C.PLACEHOLDER))})",
    ]


def build() -> dict[str, str]:
    out = {n: w(NOTES, f"SELECT doc_id, {step('text')} AS text FROM notes") for n, step in {"clean_text": cleaned, "fix_encoding": encoding, "remove_control_chars": controls, "fix_ehr_artifacts": artifacts, "normalize_whitespace": whitespace, "normalize_punctuation": punctuation}.items()}
    ab = f"ab AS ({abbreviations('notes')})"
    out["expand_abbrev_spans"] = w(NOTES, ab, SPAN + "ab")
    out["expand_abbrev_text"] = w(NOTES, ab, spliced("notes", "ab", "text || ' (' || label || ')'"))
    out["expand_abbrev_replaced"] = w(NOTES, ab, spliced("notes", "ab", "label"))
    out["phi_spans"] = w(NOTES, phi("ph", "notes"), SPAN + "ph")
    out["phi_type_counts"] = w(NOTES, phi("ph", "notes"), "SELECT label, count(*) AS n FROM ph GROUP BY label")
    out["mask_phi"] = w(NOTES, phi("ph", "notes"), spliced("notes", "ph", q(C.PLACEHOLDER)))
    out["sections"] = w(NOTES, sections("se", "notes"), 'SELECT doc_id, ord, name, "start", "end", text FROM se')
    out["section_name_counts"] = w(NOTES, sections("se", "notes"), "SELECT name, count(*) AS n FROM se GROUP BY name")
    out["section_map"] = w(NOTES, sections("se", "notes"), "SELECT doc_id, name, arg_max(text, ord) AS text FROM se GROUP BY doc_id, name")
    out["sentences"] = w(NOTES, sentences("st", "notes"), "SELECT doc_id, ord, sentence FROM st")
    out["line_class_counts"] = w(NOTES, lines("li", "notes"), "SELECT kind, count(*) AS n FROM li GROUP BY kind")
    out["preprocess_note"] = w(*_pipeline(), "SELECT doc_id, text AS cleaned_text FROM c3")
    count = lambda t: f"COALESCE((SELECT count(*) FROM {t} x WHERE x.doc_id = c3.doc_id), 0)"
    out["preprocess_summary"] = w(
        *_pipeline(), sentences("st", "c3"), sections("se", "c3"),
        f"""SELECT doc_id, text AS cleaned_text, {count("st")} AS num_sentences, {count("se")} AS num_sections,
        COALESCE((SELECT string_agg(name, '|' ORDER BY ord) FROM se WHERE se.doc_id = c3.doc_id), '') AS sections_found, {count("ph")} AS phi_masked_count, {count("ab")} AS abbreviations_expanded_count FROM c3""",
    )
    out["extract_dosage"] = w(NOTES, SPAN + f"({fi('notes', '(?i)' + C.DOSAGE, 'DOSAGE', 0)})")
    out["extract_date"] = w(NOTES, SPAN + f"({fi('notes', C.DATE, 'DATE', 0)})")
    out["extract_medication"] = w(NOTES, SPAN + f"({terms('notes', C.MEDICATIONS, 'MEDICATION', 0)})")
    out["extract_diagnosis"] = w(NOTES, SPAN + f"({terms('notes', C.DIAGNOSES, 'DIAGNOSIS', 0)})")
    out["rule_entities"] = w(NOTES, rules("ru", "notes"), SPAN + "ru")
    out["rule_entity_counts"] = w(NOTES, rules("ru", "notes"), "SELECT label, count(*) AS n FROM ru GROUP BY label")
    neg = [NOTES, rules("ru", "notes"), negated("ne", "notes", "ru")]
    out["negation"] = w(*neg, 'SELECT doc_id, text AS entity, "start", negated, trigger, trigger_type FROM ne')
    out["negation_batch"] = w(*neg, "SELECT trigger_type, trigger, count(*) AS n FROM ne GROUP BY trigger_type, trigger")
    out["whitespace_tokens"] = w(NOTES, tokens("tok", "notes"), 'SELECT doc_id, pos, token, "start", "end" FROM tok')
    out["generate_notes"] = w(made(), "SELECT doc_id, note_type, text FROM made")
    out["generated_spans"] = w(made(), 'SELECT doc_id, ord, text, label, "start", "end" FROM gold')
    out["entity_label_counts"] = w(made(), "SELECT label, count(*) AS n FROM gold GROUP BY label")
    out["bio_tags"] = w(tagged(), "SELECT * FROM tagged")
    out["subword_labels"] = w(tagged(), "SELECT doc_id, pos, tag_id FROM tagged")
    out["bio_records"] = w(
        tagged(),
        """SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens, string_agg(tag, ' ' ORDER BY pos) AS tags, string_agg(tag_id::VARCHAR, ' ' ORDER BY pos) AS tag_ids,
        string_agg("start"::VARCHAR || '-' || "end"::VARCHAR, ' ' ORDER BY pos) AS char_offsets FROM tagged GROUP BY doc_id""",
    )
    out["bio_join_anti"] = "SELECT doc_id FROM documents WHERE doc_id % 11 = 4"
    histogram = f"h AS (SELECT ids.tag, count(t.tag) AS n FROM {IDS} LEFT JOIN tagged t ON t.tag = ids.tag GROUP BY ids.tag)"
    out["tag_histogram"] = w(tagged(), histogram, "SELECT tag, n FROM h")
    out["tag_counts"] = w(tagged(), "SELECT tag, count(*) AS n FROM tagged GROUP BY tag")
    raw = "r AS (SELECT tag, (sum(n) OVER ())::DOUBLE / (11 * n + 0.1::DOUBLE) AS raw FROM h)"
    out["class_weights"] = w(tagged(), histogram, raw, "SELECT tag, round(raw / avg(raw) OVER (), 6) AS weight FROM r")
    sizes = "z AS (SELECT count(*) AS n, floor(count(*) * 0.7::DOUBLE)::BIGINT AS a, floor(count(*) * 0.15::DOUBLE)::BIGINT AS b FROM documents)"
    out["split_sizes"] = w(sizes, "SELECT 'train' AS split, a AS n FROM z UNION ALL SELECT 'val', b FROM z UNION ALL SELECT 'test', n - a - b FROM z")
    out["align_first_subword"] = w(subwords(), "SELECT doc_id, pos, word_id FROM prev WHERE word_id IS NOT NULL AND word_id IS DISTINCT FROM prev")
    out["align_labels"] = w(
        subwords(),
        "SELECT p.doc_id, p.pos, CASE WHEN p.word_id IS NOT NULL AND p.word_id IS DISTINCT FROM p.prev THEN COALESCE(t.tag_id, -100) ELSE -100 END::INT AS label FROM prev p LEFT JOIN tagged t ON t.doc_id = p.doc_id AND t.pos = p.word_id",
    )
    out["bio_decode"] = w(
        pairs(),
        """d AS (SELECT doc_id, pos, token, "start", "end", pt AS tag, 0.5::DOUBLE + (pos % 10) / 20.0::DOUBLE AS conf, SUM(CASE WHEN pt LIKE 'B-%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM named)""",
        """f AS (SELECT *, first_value(substr(tag, 3)) OVER (PARTITION BY doc_id, g ORDER BY pos) AS label FROM d WHERE g > 0)""",
        """o AS (SELECT *, SUM(CASE WHEN tag LIKE 'B-%' OR (tag LIKE 'I-%' AND substr(tag, 3) = label) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, g ORDER BY pos) AS stops FROM f)""",
        """SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text, any_value(label) AS label, min("start") AS "start", max("end") AS "end", round(min(conf), 4) AS confidence FROM o WHERE stops = 0 GROUP BY doc_id, g""",
    )
    out["ner_prf"] = w(matches(), f"t AS (SELECT {SUMS} FROM m)", f"SELECT tp, fp, fn, {ratios()} FROM t")
    exact = ratios().replace("round(", "(").replace(", 4)", ")")
    scores = ("precision", "recall", "f1")
    mean = lambda f: ", ".join(f"round({f(c)}, 4) AS {c}" for c in scores)
    out["ner_report"] = w(
        matches(), f"t AS (SELECT kind, {SUMS} FROM m GROUP BY kind)", f"u AS (SELECT {SUMS} FROM m)", f"x AS (SELECT tp, fp, fn, tp + fn AS support, {exact} FROM t)",
        f"""SELECT kind, tp, fp, fn, tp + fn AS support, {ratios()} FROM t UNION ALL SELECT 'micro avg', tp, fp, fn, tp + fn, {ratios()} FROM u
        UNION ALL SELECT 'macro avg', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(support)::BIGINT, {mean(lambda c: f"avg({c})")} FROM x
        UNION ALL SELECT 'weighted avg', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(support)::BIGINT, {mean(lambda c: f"sum({c} * support) / sum(support)")} FROM x""",
    )
    out["error_cases"] = w(pairs(), "SELECT * FROM wrong")
    out["error_distribution"] = w(pairs(), "SELECT error_type, count(*) AS n FROM wrong GROUP BY error_type")
    confusion = "cm AS (SELECT tt AS true_label, pt AS pred_label, count(*) AS n FROM kept GROUP BY tt, pt)"
    out["confusion_matrix"] = w(pairs(), confusion, "SELECT * FROM cm")
    out["top_confused_pairs"] = w(pairs(), confusion, "SELECT * FROM cm WHERE true_label <> pred_label AND true_label <> 'O' ORDER BY n DESC, true_label, pred_label LIMIT 10")
    out["entity_prf"] = w(
        pairs(),
        f"""t AS (SELECT kind, {SUMS} FROM (SELECT tk AS kind, (tt = pt)::INT AS tp, 0 AS fp, (tt <> pt)::INT AS fn FROM kept WHERE tk <> 'O' UNION ALL SELECT pk, 0, 1, 0 FROM kept WHERE tt <> pt AND pk <> 'O') GROUP BY kind)""",
        f"SELECT kind, tp, fp, fn, {ratios()} FROM t",
    )
    for name, kind in (("top_fp_words", "false_positive"), ("top_fn_words", "false_negative")):
        out[name] = w(pairs(), f"SELECT text AS word, count(*) AS n FROM wrong WHERE error_type = '{kind}' GROUP BY text ORDER BY n DESC, min(doc_id * 1000000 + pos) LIMIT 10")
    out["sample_errors"] = w(pairs(), "SELECT * FROM wrong ORDER BY doc_id, pos LIMIT 20")

    me = [NOTES, merged("me", "notes")]
    out["scorer_stub"] = w(NOTES, f"mo AS ({model('notes')})", 'SELECT doc_id, text, label, "start", "end", confidence FROM mo')
    out["dedup_entities"] = w(*me, 'SELECT doc_id, text, label, "start", "end", confidence, source FROM me_d')
    out["resolve_overlaps"] = w(*me, 'SELECT doc_id, text, label, "start", "end", confidence, source FROM me')
    out["confidence_routing"] = w(*me, "SELECT status, count(*) AS n FROM me GROUP BY status")
    out["entity_section_join"] = w(*me, 'SELECT doc_id, text, "start", section FROM me')
    out["context_snippet"] = w(*me, 'SELECT doc_id, text, "start", context_snippet FROM me')
    out["postprocess"] = w(*me, "SELECT * FROM me")
    meta = "count(me.doc_id) AS total_entities, count(*) FILTER (status = 'auto_accepted') AS auto_accepted, count(*) FILTER (status = 'flagged') AS flagged, count(*) FILTER (status = 'fallback') AS fallback_used"
    out["format_output"] = w(
        *me,
        f"""SELECT n.doc_id, 'Unknown' AS note_type, '{C.MODEL_VERSION}' AS model_version, {meta}, count(*) FILTER (status <> 'flagged') AS n_entities, count(*) FILTER (status = 'flagged') AS n_flagged FROM notes n LEFT JOIN me ON n.doc_id = me.doc_id GROUP BY n.doc_id""",
    )
    out["batch_extract"] = w(*_pipeline(), merged("me", "c3"), f"SELECT n.doc_id, {meta} FROM notes n LEFT JOIN me ON n.doc_id = me.doc_id WHERE {strip('n.text')} <> '' GROUP BY n.doc_id")
    blank = f"({strip('text')} = '')"
    tries = (
        f"tries AS (SELECT doc_id, CASE WHEN {blank} THEN 0 WHEN length(text) % 7 = 0 THEN 3 WHEN length(text) % 5 = 0 THEN 2 ELSE 1 END::INT AS attempts, "
        f"CASE WHEN {blank} THEN NULL WHEN length(text) % 7 = 0 THEN 'ValueError: length not supported' END AS error FROM notes)"
    )
    failed = "(attempts = 0 OR error IS NOT NULL)"
    out["batch_stats"] = w(NOTES, tries, f"SELECT count(*) AS total, count(*) FILTER (NOT {failed}) AS success, count(*) FILTER ({failed}) AS failed, coalesce(sum(greatest(attempts - 1, 0)), 0)::BIGINT AS retried FROM tries")
    out["batch_log_events"] = w(
        NOTES, tries,
        "steps AS (SELECT *, unnest(range(0, greatest(attempts, 1)))::INT AS ord FROM tries)",
        "last AS (SELECT *, ord = greatest(attempts, 1) - 1 AS final FROM steps)",
        "SELECT doc_id, ord, CASE WHEN attempts = 0 THEN 'WARNING' WHEN NOT final OR error IS NOT NULL THEN 'ERROR' ELSE 'INFO' END AS level, "
        "CASE WHEN attempts = 0 THEN 'document_skipped' WHEN NOT final THEN 'document_retry' WHEN error IS NOT NULL THEN 'document_failed' ELSE 'document_processed' END AS event, "
        "CASE WHEN NOT final THEN ord + 1 WHEN error IS NOT NULL THEN 3 END::INT AS attempt, CASE WHEN attempts = 0 THEN 'empty text' ELSE error END AS error FROM last",
    )
    out["audit_log_events"] = w(NOTES, f"SELECT doc_id, CASE WHEN {blank} THEN 'WARNING' ELSE 'INFO' END AS level, CASE WHEN {blank} THEN 'empty_note_skipped' ELSE 'document_processed' END AS event FROM notes")
    out["retry_counters"] = w(NOTES, tries, f"SELECT attempts, CASE WHEN {failed} THEN 'failed' ELSE 'success' END AS status, error, count(*) AS n FROM tries GROUP BY ALL")
    out["request_counter"] = "SELECT event_type AS endpoint, CASE WHEN value < 0 THEN '500' ELSE '200' END AS status, count(*) AS n FROM events GROUP BY 1, 2"
    bounds = ", ".join(f"('{b}', {b}::DOUBLE)" for b in C.LATENCY_BOUNDS) + ", ('+Inf', 'infinity'::DOUBLE)"
    out["latency_histogram"] = f"SELECT event_type AS endpoint, le, count(*) FILTER (value / 100 <= bound) AS n FROM events, (VALUES {bounds}) b(le, bound) GROUP BY event_type, le"
    out["request_metrics"] = (
        f"WITH r AS (SELECT event_type AS endpoint, CASE WHEN value < 0 THEN '500' ELSE '200' END AS status, value / 100 AS s FROM events), t AS (SELECT endpoint, status, count(*) AS n, round(sum(s), 6) AS seconds FROM r GROUP BY ALL) "
        f"SELECT endpoint, status, n, seconds, le, count(*) FILTER (s <= bound) AS n_le FROM r JOIN t USING (endpoint, status), (VALUES {bounds}) b(le, bound) GROUP BY ALL"
    )
    out["src_jsonl_lastwins"] = "SELECT conv_id::VARCHAR AS document_id, arg_max(coalesce(text, ''), turn) AS text FROM conversations GROUP BY conv_id"
    out["src_jsonl_bad_lines"] = "SELECT count(*) AS good, count(*) FILTER (turn = 0) AS bad FROM conversations"
    return out


ORACLE_SQL = build()
assert all(re.match("WITH|SELECT", s) for s in ORACLE_SQL.values())
