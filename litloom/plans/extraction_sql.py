"""DuckDB SQL of extraction, classes of entities, and slugs.

RE2's classes are ASCII's, so patterns are matched on a shadow of the text of the same length: letters,
marks and digits beyond ASCII stand as ``_``, other characters beyond it as ``~``. Places found there
hold for the text. Compatibility forms are given by tables made from the Unicode data.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from litloom.functions import vocab

_WORD = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}"
_ENDS = r"[ ,.;:()\[\]]+"


def text_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(values) -> str:
    return ", ".join(text_literal(v) for v in values)


def shadow(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[^\x00-\x7F{_WORD}]', '~', 'g'), '[^\x00-\x7F]', '_', 'g')"


def on_shadow(pattern: str) -> str:
    """A pattern of the vocabulary for RE2 and the shadow."""
    flags = "(?i)" if pattern.startswith("(?iU)") or pattern.startswith("(?iu)") else ""
    for f in ("(?iU)", "(?U)", "(?iu)"):
        pattern = pattern.removeprefix(f)
    return flags + pattern.replace("κ", "_")


@cache
def _compatible(form: str) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters of one and of several characters in a normal form of compatibility."""
    one, several = [], []
    for o in range(0x80, 0x10000):
        c = chr(o)
        if unicodedata.category(c) in ("Cs", "Cn", "Co") or 0xAC00 <= o < 0xD7A4:
            continue
        n = unicodedata.normalize(form, c)
        if form == "NFKD":
            n = "".join(x for x in n if x.isascii())
        if n != c and (len(n) == 1 or not n and form == "NFKD"):
            one.append((c, n or "\x7f"))
        elif n != c and len(n) > 1 and n.isascii() and (0xFB00 <= o < 0xFB07 or o < 0x200 or 0x2000 <= o < 0x2200):
            several.append((c, n))
    return "".join(a for a, _ in one), "".join(b for _, b in one), tuple(several)


def compatible(x: str, form: str = "NFKC") -> str:
    a, b, several = _compatible(form)
    x = f"translate({x}, {text_literal(a)}, {text_literal(b)})"
    for c, n in several:
        x = f"replace({x}, {text_literal(c)}, {text_literal(n)})"
    return x


def slug(x: str) -> str:
    plain = rf"regexp_replace({compatible(f'nfc_normalize({x})', 'NFKD')}, '[^\x00-\x7E]', '', 'g')"
    return f"trim(regexp_replace(lower({plain}), '[^a-z0-9]+', '_', 'g'), '_')"


def entity_norm(x: str, white: str) -> str:
    s = f"lower(trim(regexp_replace({compatible(x)}, '{white}', ' ', 'g')))"
    s = rf"regexp_replace(regexp_replace({s}, '[^{_WORD}\s\-κ]+', '', 'g'), '{white}', ' ', 'g')"
    return f"(SELECT CASE WHEN n LIKE '%s' AND length(n) > 3 THEN n[1:length(n) - 1] ELSE n END FROM (SELECT {s} AS n))"


def entity_kind(x: str, white: str) -> str:
    s = f"regexp_replace({x}, '^{white}|{white}$', '', 'g')"
    held = f"({shadow(s)})"

    def some(patterns) -> str:
        return "(" + " OR ".join(f"regexp_matches({held}, {text_literal(on_shadow(p))})" for p in patterns) + ")"

    gene = f"upper({s}) IN ({any_of(vocab.KNOWN_GENES)}) OR regexp_full_match({s}, {text_literal(vocab.GENE)}) AND upper({s}) NOT IN ({any_of(vocab.GENE_STOP_WORDS)})"
    return (
        f"CASE WHEN {s} IS NULL OR {s} = '' THEN 'OTHER' WHEN {some(vocab.PATHWAYS)} THEN 'PATHWAY' WHEN {some(vocab.DISEASES)} THEN 'DISEASE' WHEN {some(vocab.CHEMICALS)} THEN 'CHEMICAL' "
        f"WHEN {some([vocab.PROCESS])} THEN 'BIOLOGICAL_PROCESS' WHEN {some([vocab.PROTEIN])} THEN 'PROTEIN' WHEN {gene} THEN 'GENE' ELSE 'OTHER' END"
    )


def _found(source: str, rules) -> str:
    """(article_ord, sent_ord, rule, k, start, stop) of the matches of numbered patterns in a.shadow."""
    mark = lambda p: f"string_split(regexp_replace(shadow, {text_literal('(' + p + ')')}, concat(chr(1), '\\1', chr(2)), 'g'), chr(1))"
    each = " UNION ALL ".join(f"SELECT article_ord, sent_ord, {i} AS rule, {mark(p)} AS parts FROM {source}" for i, p in rules)
    return f"""SELECT article_ord, sent_ord, rule, k - 2 AS k, start, start + instr(parts[k], chr(2)) - 1 AS stop FROM (
      SELECT *, (list_sum(list_transform(parts[1:k - 1], lambda p: length(p))) - (k - 2))::INT AS start FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS k FROM ({each})))"""


def tagged(cleaned: str, white: str) -> str:
    """WITH clauses: sentences ``s`` and their spans ``e`` (span_ord, start, stop, text, confidence, kind)."""
    confidence = " ".join(f"WHEN {i} THEN {c}" for i, (c, _) in enumerate(vocab.SPAN_PATTERNS))
    return rf"""WITH f AS ({cleaned}), x AS (
  SELECT article_ord, pmid, year, trim(regexp_replace(translate(concat_ws(' ', nullif(title, ''), nullif(abstract, '')), chr(1) || chr(2), '  '), '{white}', ' ', 'g')) AS t FROM f
), u AS (
  SELECT article_ord, pmid, year, list_filter(list_transform(string_split(regexp_replace(t, '([.!?;]) ([A-Z0-9])', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda v: trim(v)), lambda v: v <> '') AS l FROM x
), s0 AS (SELECT article_ord, pmid, year, (generate_subscripts(l, 1) - 1)::INT AS sent_ord, unnest(l) AS sentence FROM u
), s AS (SELECT *, {shadow('sentence')} AS shadow FROM s0
), m AS ({_found('s', [(i, on_shadow(p)) for i, (_, p) in enumerate(vocab.SPAN_PATTERNS)])}
), c AS (
  SELECT m.*, regexp_replace(sentence[start + 1:stop], '^{_ENDS}|{_ENDS}$', '', 'g') AS text, (CASE rule {confidence} END)::DOUBLE AS confidence FROM m JOIN s USING (article_ord, sent_ord)
), g AS (
  SELECT article_ord, sent_ord, list_reduce(list({{'last': stop, 'kept': [{{'start': start, 'stop': stop, 'text': text, 'confidence': confidence}}]}} ORDER BY start, stop DESC, rule),
    lambda a, b: CASE WHEN b.kept[1].start >= a.last THEN {{'last': b.last, 'kept': list_concat(a.kept, b.kept)}} ELSE a END).kept AS kept
  FROM c WHERE text <> '' AND NOT (rule = 0 AND upper(text) IN ({any_of(vocab.GENE_STOP_WORDS)})) GROUP BY article_ord, sent_ord
), e0 AS (SELECT article_ord, sent_ord, unnest(kept) AS v FROM g
), e1 AS (SELECT article_ord, sent_ord, v.start AS start, v.stop AS stop, v.text AS text, v.confidence AS confidence, {entity_kind('v.text', white)} AS kind FROM e0
), e AS (
  SELECT *, (row_number() OVER (PARTITION BY article_ord, sent_ord ORDER BY start) - 1)::INT AS span_ord, {entity_norm('text', white)} AS normalized FROM e1 WHERE kind <> 'OTHER' OR length(text) >= 4
)"""


def entities(cleaned: str, white: str) -> str:
    return tagged(cleaned, white) + """
SELECT article_ord, sent_ord, span_ord, text, normalized, kind AS entity_type, pmid, sentence, confidence FROM e JOIN s USING (article_ord, sent_ord)
QUALIFY row_number() OVER (PARTITION BY article_ord, normalized, kind, sentence ORDER BY sent_ord, span_ord) = 1"""


def relations(cleaned: str, white: str) -> str:
    def cues(x: str, values) -> str:
        return "(" + " OR ".join(f"contains({x}, {text_literal(v)})" for v in values) + ")"

    def by_rule(values) -> str:
        return "CASE rule " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    t = vocab.TRIGGERS
    verb = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.inflections().items())
    base = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.CONFIDENCE_BASE.items())
    penalty = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.CERTAINTY_PENALTY.items())
    less = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.POLARITY_PENALTY.items())
    return tagged(cleaned, white) + rf""", n AS (SELECT article_ord, sent_ord FROM e GROUP BY ALL HAVING count(*) >= 2
), st AS (SELECT s.* FROM s JOIN n USING (article_ord, sent_ord)
), tr AS ({_found('st', [(i, rf'(?i)\b(?:{p[0]})\b') for i, p in enumerate(t)])}
), w AS (
  SELECT tr.*, sentence, pmid, year, lower(sentence[start + 1:stop]) AS said, lower(sentence[greatest(1, start - 39):start]) AS before_it FROM tr JOIN st USING (article_ord, sent_ord)
), b AS (
  SELECT w.*, arg_max(e, e.span_ord) FILTER (e.stop <= w.start) AS lhs, arg_min(e, e.span_ord) FILTER (e.start >= w.stop) AS rhs FROM w JOIN e USING (article_ord, sent_ord) GROUP BY ALL
), o AS (
  SELECT article_ord, sent_ord, rule, k, sentence, pmid, year, before_it, {by_rule('TRUE' if x[3] else 'FALSE' for x in t)} AS swap, coalesce({by_rule(text_literal(x[1]) if x[1] else 'NULL' for x in t)}, CASE said {verb} ELSE said END) AS predicate,
    {by_rule(text_literal(x[2]) for x in t)} AS base, CASE WHEN swap THEN rhs ELSE lhs END AS su, CASE WHEN swap THEN lhs ELSE rhs END AS ob FROM b WHERE lhs IS NOT NULL AND rhs IS NOT NULL
), q AS (
  SELECT *, CASE WHEN {cues('lower(sentence)', vocab.SPECULATIVE_CUES)} THEN 'speculative' WHEN {cues('lower(sentence)', vocab.POSSIBLE_CUES)} THEN 'possible' WHEN {cues('lower(sentence)', vocab.PROBABLE_CUES)} THEN 'probable' ELSE 'certain' END AS certainty,
    {cues('lower(sentence)', vocab.CONDITIONAL_CUES)} AS conditional, {cues('before_it', vocab.NEGATION_CUES)} AS negated FROM o WHERE su.normalized <> ob.normalized
), p AS (
  SELECT *, CASE WHEN conditional THEN 'conditional' WHEN certainty <> 'certain' THEN 'uncertain' WHEN negated THEN CASE WHEN base = 'negative' THEN 'positive' ELSE 'negative' END ELSE base END AS polarity,
    (CASE predicate {base} ELSE {vocab.CONFIDENCE_OTHER} END)::DOUBLE AS bc FROM q
)
SELECT article_ord, sent_ord, rule AS spec_ord, k::INT AS match_ord, su.text AS subject, predicate, ob.text AS object, sentence, pmid, year AS publication_year, polarity, certainty,
  greatest(0, least(1, round(bc - ((CASE certainty {penalty} END)::DOUBLE + (CASE polarity {less} ELSE 0 END)::DOUBLE) + 0.02 * sqrt(bc), 3))) AS confidence, 'rule_based' AS source, su.kind AS subject_type, ob.kind AS object_type
FROM p QUALIFY row_number() OVER (PARTITION BY article_ord, lower(su.text), predicate, lower(ob.text), sentence ORDER BY sent_ord, rule, k) = 1"""


def nested(white: str) -> str:
    """The flat rows of nested payloads (problem 6)."""

    def items(j: str) -> str:
        return f"(CASE json_type({j}) WHEN 'ARRAY' THEN from_json({j}, '[\"json\"]') ELSE [{j}] END)"

    def outer(x: str) -> str:
        return f"nullif(regexp_replace({x}, '^{white}|{white}$', '', 'g'), '')"

    def said(j: str) -> str:
        inner = f"json_extract({j}, '$.\"#text\"')"
        plain = lambda x: f"(CASE WHEN json_type({x}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN {x} ->> '$' END)"
        return outer(f"(CASE json_type({j}) WHEN 'OBJECT' THEN {plain(inner)} ELSE {plain(j)} END)")

    def listed(source: str, key: str, j: str, name: str, at: str) -> str:
        return f"SELECT {key}, unnest({items(j)}) AS {name}, generate_subscripts({items(j)}, 1) - 1 AS {at} FROM {source} WHERE {j} IS NOT NULL"

    get = lambda j, path: f"json_extract({j}, '$.{path}')"
    last, first = said(get("a", "LastName")), said(get("a", "ForeName"))
    doi = lambda kind: f"lower(coalesce(i ->> '$.{kind}', '')) = 'doi'"
    return f"""WITH j AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS r FROM raw_records), o AS (SELECT raw_id, r FROM j WHERE json_type(r) = 'OBJECT'
), au AS ({listed('o', 'raw_id', get('r', 'MedlineCitation.Article.AuthorList.Author'), 'a', 'pos')}
), af AS ({listed('au', 'raw_id, pos', get('a', 'AffiliationInfo'), 'i', 'sub')}
), mh AS ({listed('o', 'raw_id', get('r', 'MedlineCitation.MeshHeadingList.MeshHeading'), 'm', 'pos')}
), md AS (SELECT raw_id, pos, {said(get('m', 'DescriptorName'))} AS d, {get('m', 'QualifierName')} AS q FROM mh
), mq0 AS ({listed('md', 'raw_id, pos, d', 'q', 'i', 'sub')}
), mq AS (SELECT raw_id, pos, sub, d, {said('i')} AS v FROM mq0
), kl AS ({listed('o', 'raw_id', get('r', 'MedlineCitation.KeywordList'), 'k', 'pos')}
), kw AS ({listed('kl', 'raw_id, pos', get('k', 'Keyword'), 'i', 'sub')}
), ids0 AS ({listed('o', 'raw_id', get('r', 'PubmedData.ArticleIdList.ArticleId'), 'i', 'p')}
), ids AS (SELECT raw_id, 1 AS rank, p, {said('i')} AS v FROM ids0 WHERE {doi('IdType')}
), loc0 AS ({listed('o', 'raw_id', get('r', 'MedlineCitation.Article.ELocationID'), 'i', 'p')}
), loc AS (SELECT raw_id, 2 AS rank, p, {said('i')} AS v FROM loc0 WHERE {doi('EIdType')}
), one AS (SELECT * FROM (SELECT * FROM ids UNION ALL SELECT * FROM loc) QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY rank, p) = 1
), flat AS (
  SELECT raw_id, 'author' AS child, pos, -1 AS sub, coalesce({said(get('a', 'CollectiveName'))}, CASE WHEN {last} IS NOT NULL AND {first} IS NOT NULL THEN concat({last}, ', ', {first}) ELSE coalesce({last}, {first}) END) AS val FROM au
  UNION ALL SELECT raw_id, 'affiliation', pos, sub, {said(get('i', 'Affiliation'))} FROM af
  UNION ALL SELECT raw_id, 'mesh', pos, sub, concat(d, ' / ', v) FROM mq WHERE d IS NOT NULL AND v IS NOT NULL
  UNION ALL SELECT raw_id, 'mesh', pos, -1, d FROM md WHERE d IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mq WHERE mq.raw_id = md.raw_id AND mq.pos = md.pos AND mq.v IS NOT NULL)
  UNION ALL SELECT raw_id, 'keyword', pos, sub, {said('i')} FROM kw
  UNION ALL SELECT raw_id, 'doi', 0, -1, v FROM one
) SELECT raw_id, child, pos::INT AS pos, sub::INT AS sub, val FROM flat WHERE val IS NOT NULL"""
