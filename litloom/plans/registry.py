"""Queries of the core operators over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions import text as X
from litloom.functions import vocab
from litloom.operators import analysis, clean, extract, gaps, graph, hypotheses, nested
from litloom.session import cut, spread, table
from litloom.sources import articles as sources
from litloom.sources import sinks, xml

from . import extraction_sql

CUTOFF = 2015
THIS_YEAR = 2026  # the clock of compared queries


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.evidence(table(spark, d, "relations"))


def _flat(edges: DataFrame) -> DataFrame:
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c)
    return edges.select("layer", "subject", "object", "predicate", join("predicates"), join("pmids"), join("years"), "confidence", "weight")


# --- text -----------------------------------------------------------------------------------------


def normalize_text(spark, d):
    return table(spark, d, "articles").select("article_ord", X.normalize_text(F.col("title")).alias("title"), X.normalize_text(F.col("abstract")).alias("abstract"))


def truncate_text(spark, d):
    return table(spark, d, "articles").select("article_ord", X.truncate(F.col("title"), 40).alias("short"))


def slugs(spark, d):
    return table(spark, d, "articles").select("article_ord", X.slugify(F.col("title")).alias("slug"))


def record_checks(spark, d):
    return table(spark, d, "articles").select("article_ord", X.is_pmid(F.col("pmid")).alias("pmid_ok"), X.valid_year(F.col("year"), F.lit(THIS_YEAR)).alias("year_ok"), X.escape_html(F.col("title")).alias("title_html"))


def sentence_split(spark, d):
    a = table(spark, d, "articles").select("article_ord", "title", "abstract")
    return extract.sentences(a).select("article_ord", "sent_ord", "sentence")


def cue_flags(spark, d):
    s = F.col("sentence")
    r = table(spark, d, "relations")
    return r.select("rel_ord", X.certainty(s).alias("certainty_cue"), X.is_conditional(s).alias("conditional"), X.negated_before(s, F.lit(40)).alias("negated_40"))


def entity_classes(spark, d):
    return table(spark, d, "entities").select("entity_id", X.entity_type(F.col("text")).alias("kind"), X.normalize_entity(F.col("text")).alias("norm"))


def relation_confidence(spark, d):
    r = table(spark, d, "relations")
    return r.select("rel_ord", X.relation_confidence(F.col("predicate"), F.col("certainty"), F.col("polarity")).alias("score"), X.verb_predicate(F.col("predicate")).alias("verb"), X.graph_predicate(F.col("predicate")).alias("edge_predicate"))


def evidence_lines(spark, d):
    r = table(spark, d, "relations")
    return r.select("rel_ord", X.evidence_line(F.col("subject"), F.col("object"), F.col("predicate"), F.col("pmid"), F.col("confidence")).alias("line"))


# --- sources and cleaning -------------------------------------------------------------------------


def article_clean(spark, d):
    c = clean.clean_articles(table(spark, d, "articles"), this_year=F.lit(THIS_YEAR))
    return c.select("article_ord", "pmid", "title", "abstract", F.array_join("authors", ";").alias("authors"), "journal", "year", F.array_join("mesh_terms", ";").alias("mesh_terms"), F.array_join("keywords", ";").alias("keywords"), "doi")


def article_years(spark, d):
    a = clean.year_window(table(spark, d, "articles"), 2005, CUTOFF)
    return a.select("article_ord", "year", X.article_text(F.col("title"), F.col("abstract")).alias("body"))


def corpus_search(spark, d):
    return sources.search(table(spark, d, "articles"), "KLV53 pathway").select("article_ord", "pmid")


def fetch_selected(spark, d):
    some = table(spark, d, "relations").where("polarity = 'conditional'").select("pmid")
    return sources.fetch(table(spark, d, "articles"), some).select("article_ord", "pmid", "year")


def xml_round_trip(spark, d):
    """Every cleaned article written as XML and read back."""
    c = clean.clean_articles(table(spark, d, "articles"), this_year=F.lit(THIS_YEAR), preserve_case=True)
    return xml.parse_xml(sources_xml(c), limit=THIS_YEAR + 1)


def xml_scan(spark, d):
    """Every article as a document of the format's rarer parts: markup in the title, labelled sections, free dates, the
    journal's short name, group authors, qualifiers, location ids; read back."""
    a = table(spark, d, "articles")
    safe = lambda c: X.escape_html(F.regexp_replace(X.text(c), _ILLEGAL, ""))
    el = lambda tag, *inner: F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag.split()[0]}>"))
    some = lambda c: F.filter(F.coalesce(c, F.array()), lambda x: x.isNotNull())
    each = lambda c, f: F.array_join(F.transform(some(F.col(c)), f), "")
    o = F.col("article_ord")
    authors = each("authors", lambda x, i: el("Author", F.when(i % 2 == 1, el("CollectiveName", safe(x))).otherwise(el("LastName", safe(x)))))
    mesh = each("mesh_terms", lambda x, i: el("MeshHeading", el("DescriptorName", safe(x)), F.when(i % 2 == 1, F.lit("<QualifierName>one</QualifierName><QualifierName> </QualifierName><QualifierName> two </QualifierName>")).otherwise("")))
    words = each("keywords", lambda x: el("Keyword", safe(x)))
    article_id = F.when(o % 3 == 0, el('ArticleId IdType="DOI"', safe(F.col("doi")))).when(o % 3 == 1, "").otherwise('<ArticleId IdType="doi"> </ArticleId>')
    doc = el("Set", el("PubmedArticle", el(
        "MedlineCitation", el("PMID", F.lit(" "), safe(F.col("pmid"))), el(
            "Article", el("ArticleTitle", el("b", safe(F.col("title"))), F.lit(" <i/>")),
            el("Abstract", el('AbstractText Label="METHODS"', safe(F.col("abstract"))), F.lit('<AbstractText Label="NONE"> </AbstractText>'), el("AbstractText", safe(F.col("journal")))), el("AuthorList", authors),
            el("Journal", el("JournalIssue", el("PubDate", el("MedlineDate", F.coalesce(F.concat(F.lit("Spring "), F.col("year").cast("string")), F.lit("Winter")))))), F.lit("<ArticleDate><Year>2001</Year></ArticleDate>"),
            el('ELocationID EIdType="doi"', F.lit("10.1/"), o.cast("string")),
        ), el("MedlineJournalInfo", el("MedlineTA", safe(F.col("journal")))), el("MeshHeadingList", mesh), el("KeywordList", words),
    ), el("PubmedData", el("ArticleIdList", article_id))))
    return xml.parse_xml(a.select(doc.alias("xml")), limit=THIS_YEAR + 1)


_ILLEGAL = r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def sources_xml(a: DataFrame) -> DataFrame:
    legal = lambda c: F.regexp_replace(c, _ILLEGAL, "")
    return xml.to_xml(a.withColumns({c: legal(F.col(c)) for c in ("title", "abstract", "journal")}))


def p6_found(spark, d):
    return nested.flatten(spread(table(spark, d, "raw_records")))


# --- extraction -----------------------------------------------------------------------------------


def _tagged(spark, d):
    a = clean.clean_articles(spread(table(spark, d, "articles")), this_year=F.lit(THIS_YEAR), preserve_case=True)
    return extract.with_spans(extract.sentences(a.select("article_ord", "pmid", "year", "title", "abstract")))


def entities_extract(spark, d):
    return extract.entities(_tagged(spark, d))


def relations_extract(spark, d):
    return extract.relations(_tagged(spark, d))


def relation_dedupe(spark, d):
    r = extract.dedupe_relations(table(spark, d, "relations"), ["rel_ord"])
    return r.select("rel_ord", "subject", "predicate", "object", "pmid", "polarity", "confidence", F.col("sort_key.first.rel_ord").alias("first_ord"))


# --- graph ----------------------------------------------------------------------------------------


def edge_merge(spark, d):
    return _flat(graph.merge_edges(_evidence(spark, d)))


def temporal_layer(spark, d):
    return _flat(graph.merge_edges(graph.temporal_rows(_evidence(spark, d), CUTOFF)))


def temporal_snapshot(spark, d):
    return _flat(graph.snapshot(graph.merge_edges(_evidence(spark, d)), CUTOFF))


def negative_edges(spark, d):
    n = graph.negative_edges(_evidence(spark, d))
    return n.select("subject", "object", "predicate", "n_relations", F.array_join("pmids", ";").alias("pmids"), F.array_join(F.transform("years", lambda y: y.cast("string")), ";").alias("years"))


def node_types(spark, d):
    return graph.nodes(_evidence(spark, d))


def combined_graph(spark, d):
    e = graph.combined(graph.merge_edges(_evidence(spark, d)))
    return e.select("subject", "object", "layer", "predicate", "weight")


def degree_top10(spark, d):
    ev = _evidence(spark, d)
    und = graph.undirected(ev.where("layer <> 'negative'"))
    return graph.top_nodes(graph.degrees(graph.nodes(ev), und))


def degree_distribution(spark, d):
    ev = _evidence(spark, d)
    return analysis.counts(graph.degrees(graph.nodes(ev), graph.undirected(ev.where("layer <> 'negative'"))), "degree")


def components(spark, d):
    ev = _evidence(spark, d)
    return graph.components(graph.nodes(ev), graph.undirected(ev.where("layer <> 'negative'")))


def graph_stats(spark, d):
    return graph.statistics(_evidence(spark, d)).drop("summary_json")


def edge_repeats_removed(spark, d):
    """Edges whose lists repeat every value, as a careless merge makes them, and what is left of them."""
    twice = {c: F.concat(c, F.reverse(c)) for c in ("pmids", "years", "predicates")}
    e = graph.repeated_values(graph.merge_edges(_evidence(spark, d)).withColumns(twice).withColumn("predicate", F.lit("?")))
    return _flat(e.withColumn("confidence", F.col("n_removed").cast("double"))).drop("weight").withColumnRenamed("confidence", "n_removed")


def negative_confidences(spark, d):
    """Each negative edge's confidences with the number of its relations that have them."""
    n = graph.negative_edges(_evidence(spark, d)).select("subject", "object", F.explode("confidences").alias("c"))
    return n.select("subject", "object", "c.confidence", "c.n")


def incremental_edges(spark, d):
    """Edges of all relations, counted in by three batches one after another; they must be those of edge_merge."""
    ev = _evidence(spark, d)
    last = ev.agg(F.max("ord")).first()[0] or 0
    batch = lambda i: ev.where((F.col("ord") > last * i // 3 - (i == 0)) & (F.col("ord") <= last * (i + 1) // 3))
    parts = graph.edge_parts(batch(0))
    for i in (1, 2):
        parts = graph.add_relations(parts, batch(i))
    return _flat(graph.edges_of(*parts))


def repeated_edge_values(spark, d):
    e = graph.repeated_values(graph.merge_edges(_evidence(spark, d)))
    return e.select("layer", "subject", "object", "predicate", "n_removed")


# --- gaps -----------------------------------------------------------------------------------------


def _und(spark, d):
    ev = _evidence(spark, d)
    return graph.undirected(ev.where("layer = 'biological'")), graph.nodes(ev), ev


def gap_scores(spark, d):
    und, nodes, _ = _und(spark, d)
    und = cut(und)
    numbers = gaps.numbered(und, nodes)
    s = gaps.named(gaps.score(gaps.shared_neighbours(und, nodes, nodes=numbers)), numbers)
    return s.select("node_a", "node_b", "node_a_type", "node_b_type", F.col("cn").alias("common_neighbors"), F.round("jaccard", 6).alias("jaccard"), F.round("aa", 6).alias("adamic_adar"), F.round("ra", 6).alias("resource_allocation"), "score", "method")


def _gap_columns(g: DataFrame) -> DataFrame:
    return g.select("node_a", "node_b", "node_a_type", "node_b_type", "score", "method", F.array_join("common_neighbors", ";").alias("common_neighbors"), "novelty_status", F.size("evidence_pmids").alias("n_pmids"), "max_year")


def gap_candidates_topk(spark, d):
    return _gap_columns(gaps.find_gaps(_evidence(spark, d), top_k=20))


def gap_candidates_cutoff(spark, d):
    return _gap_columns(gaps.find_gaps(_evidence(spark, d), CUTOFF, 20))


def hop2_pairs(spark, d):
    return gaps.pairs_at_distance(_und(spark, d)[0], 2)


def hop3_pairs(spark, d):
    return gaps.pairs_at_distance(_und(spark, d)[0], 3)


def novelty_status(spark, d):
    """Pairs that negative relations name, in either direction, without the synonym branch."""
    und, _, ev = _und(spark, d)
    neg = graph.negative_edges(ev)
    p = neg.select(F.col("object").alias("node_a"), F.col("subject").alias("node_b"), F.size("pmids").alias("n_pmids"), F.lit(0).alias("n_common"))
    return gaps.novelty(p, und, neg, CUTOFF, synonyms=False).select("node_a", "node_b", "novelty_status")


def synonym_pairs(spark, d):
    """Typed forms of nodes beside their labels."""
    n = graph.nodes(_evidence(spark, d))
    p = n.select(F.col("node").alias("a"), F.regexp_replace("label", r"[^\w]", "").alias("b"))
    return p.withColumn("alike", X.are_synonyms(F.col("a"), F.col("b")))


# --- hypotheses -----------------------------------------------------------------------------------


def hypothesis_generate(spark, d):
    r = table(spark, d, "relations")
    g = cut(gaps.find_gaps(graph.evidence(r), top_k=20))
    h = hypotheses.run(g, r, "KLV53", 20, source=X.node_key(F.col("subject")), target=X.node_key(F.col("object")))
    return h.select("hypothesis_id", "node_a", "node_b", "hypothesis", "gap_novelty", "novelty_status", F.size("supporting_evidence").alias("n_supporting"), F.size("contradicting_evidence").alias("n_contradicting"), F.round("evidence_score", 6).alias("evidence_score"), "novelty_score", "plausibility_score", "feasibility_score", F.round("final_score", 6).alias("final_score"), F.round((F.col("evidence_score") + F.col("novelty_score") + F.col("plausibility_score")) / 3, 6).alias("mean_score"))


def evidence_join(spark, d):
    """How many relations support and contradict each pair of stored hypotheses, as they name them."""
    h = table(spark, d, "hypotheses").where("size(entities) >= 2").select(F.lower(F.col("entities")[0]).alias("node_a"), F.lower(F.col("entities")[1]).alias("node_b")).distinct()
    c = h.withColumn("common_neighbors", F.array().cast("array<string>"))
    e = hypotheses.evidence(c, table(spark, d, "relations"), X.node_key(F.col("subject")), X.node_key(F.col("object")))
    return e.select("node_a", "node_b", "contradicts", F.size("items").cast("long").alias("n"))


def hypothesis_scores(spark, d):
    h = table(spark, d, "hypotheses")
    return h.select("hypothesis_id", "generated_at", F.round(hypotheses.evidence_score(F.col("supporting_evidence"), F.col("contradicting_evidence")), 6).alias("evidence"), hypotheses.novelty_score(F.col("novelty_status")).alias("novelty"), hypotheses.feasibility_score(F.col("suggested_experiment")).alias("feasibility"), X.score_bucket(F.col("confidence")).alias("level"), X.score_bar(F.col("confidence")).alias("bar"))


def hypothesis_order(spark, d):
    h = table(spark, d, "hypotheses")
    return analysis.sort_hypotheses(h, "confidence").limit(10).select("hypothesis_id", "confidence")


def hypothesis_places(spark, d):
    """Every hypothesis with its place; hypothesis_order has the first ten."""
    h = table(spark, d, "hypotheses")
    return analysis.places(analysis.sort_hypotheses(h, "confidence").select("hypothesis_id", "confidence"))


def hypothesis_averages(spark, d):
    f = analysis.hypothesis_figures(table(spark, d, "hypotheses"))
    return f.select("n_hypotheses", *[F.round(c, 4).alias(c) for c in f.columns[1:]])


# --- analysis -------------------------------------------------------------------------------------


def evidence_filter(spark, d):
    r = analysis.filter_evidence(table(spark, d, "relations"), "klv53", ("activates", "inhibits"), ("positive", "negative"), ("certain",), (2005, CUTOFF), 0.8)
    return r.select("rel_ord", "subject", "predicate", "object", "confidence")


def evidence_top(spark, d):
    return analysis.by_confidence(table(spark, d, "relations"), k=10).select("rel_ord", "confidence")


def evidence_places(spark, d):
    """Every relation with its place by confidence; evidence_top has the first ten."""
    return analysis.places(analysis.by_confidence(table(spark, d, "relations")).select("rel_ord", "confidence"))


def gap_filter(spark, d):
    g = gaps.find_gaps(_evidence(spark, d), top_k=200, pmids=False)
    kept = analysis.filter_gaps(g, ("CONTRADICTED", "PARTIALLY_SUPPORTED"), 0.7, ("DISEASE",))
    return sinks.gap_table(analysis.sort_gaps(kept, "Novelty"))


def gap_sorts(spark, d):
    """The best 50 gaps with their place in each of the three sorts."""
    g = cut(gaps.find_gaps(_evidence(spark, d), top_k=50).select("node_a", "node_b", "score", "novelty_status"))
    out = [analysis.places(analysis.sort_gaps(g, by)).select(F.lit(by).alias("sort"), "node_a", "node_b", "place") for by in ("Score", "Novelty", "Alphabetical")]
    return out[0].unionByName(out[1]).unionByName(out[2])


OTHER_PAIRS = (("DISEASE", "CHEMICAL"), ("PATHWAY", "GENE"))


def gap_other_pairs(spark, d):
    """The best gaps of type pairs given by the caller."""
    return _gap_columns(gaps.find_gaps(_evidence(spark, d), top_k=20, pairs=OTHER_PAIRS))


def hypothesis_sorts(spark, d):
    """Every hypothesis with its place by each score that can sort them."""
    h = table(spark, d, "hypotheses").select("hypothesis_id", "generated_at", *_SORTS)
    out = [analysis.places(analysis.sort_hypotheses(h.select("hypothesis_id", F.col(c)), c)).select(F.lit(c).alias("sort"), "hypothesis_id", "place") for c in _SORTS]
    return reduce(DataFrame.unionByName, out)


_SORTS = ("final_score", "evidence_score", "novelty_score", "plausibility_score", "feasibility_score")


def gap_figures(spark, d):
    return analysis.gap_figures(gaps.find_gaps(_evidence(spark, d), top_k=50))


def entity_type_counts(spark, d):
    return analysis.counts(table(spark, d, "entities"), "entity_type")


def top_entities(spark, d):
    return analysis.most_frequent(table(spark, d, "entities"), "normalized", "entity_id")


def polarity_counts(spark, d):
    return analysis.counts(table(spark, d, "relations"), "polarity")


def option_lists(spark, d):
    return analysis.options(table(spark, d, "relations"), "predicate", "polarity", "certainty", "subject_type", end_type=("subject_type", "object_type"))


def years_covered(spark, d):
    return analysis.years_covered(table(spark, d, "articles"))


def middle_year(spark, d):
    return analysis.middle_year(table(spark, d, "relations"))


def relation_articles(spark, d):
    """Relations with the title of the last article of their pmid."""
    a = table(spark, d, "articles").groupBy("pmid").agg(F.max_by("title", "article_ord").alias("title"))
    return table(spark, d, "relations").select("rel_ord", "pmid").join(a, "pmid", "left").select("rel_ord", "title")


def run_metadata(spark, d):
    r = table(spark, d, "relations")
    ev = graph.evidence(r)
    m = analysis.metadata(table(spark, d, "articles"), table(spark, d, "entities"), r, graph.statistics(ev), gaps.find_gaps(ev, top_k=50), table(spark, d, "hypotheses"), "KLV53", CUTOFF)
    return m


def graph_export(spark, d):
    ev = _evidence(spark, d)
    lines = sinks.graphml(graph.nodes(ev), graph.combined(graph.merge_edges(ev)))
    return lines.select("section", "key", "line")


_CORE = (
    gap_candidates_topk, normalize_text, truncate_text, slugs, record_checks, sentence_split, cue_flags, entity_classes, relation_confidence, evidence_lines, article_clean, article_years, corpus_search,
    fetch_selected, xml_round_trip, xml_scan, p6_found, entities_extract, relations_extract, relation_dedupe, edge_merge, temporal_layer, temporal_snapshot, negative_edges, node_types, combined_graph, degree_top10,
    degree_distribution, components, graph_stats, repeated_edge_values, edge_repeats_removed, negative_confidences, incremental_edges, gap_scores, gap_candidates_cutoff, hop2_pairs, hop3_pairs, novelty_status, synonym_pairs, hypothesis_generate, evidence_join,
    hypothesis_scores, hypothesis_order, hypothesis_places, hypothesis_averages, evidence_filter, evidence_top, evidence_places, gap_filter, gap_sorts, gap_other_pairs, hypothesis_sorts, gap_figures, entity_type_counts, top_entities, polarity_counts, option_lists, years_covered,
    middle_year, relation_articles, run_metadata, graph_export,
)


def queries() -> dict:
    return {f.__name__: f for f in _CORE}


# --- SQL ------------------------------------------------------------------------------------------

_W = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_W}', ' ', 'g'))"


def _norm(x: str) -> str:
    return _collapse(f"lower(nfc_normalize(coalesce({x}, '')))")


def _key(x: str) -> str:
    return _collapse(f"lower(coalesce({x}, ''))")


def _outer(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^{_W}|{_W}$', '', 'g')"


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _any(x: str, cues) -> str:
    return "(" + " OR ".join(f"contains({x}, '{c}')" for c in cues) + ")"


_EV = f"""
WITH ev0 AS (
  SELECT rel_ord AS ord, {_key('subject')} AS s, {_key('object')} AS o, subject AS sl, object AS ol, coalesce(nullif(subject_type, ''), 'OTHER') AS st, coalesce(nullif(object_type, ''), 'OTHER') AS ot,
    replace({_key('predicate')}, ' ', '_') AS p, coalesce(pmid, '') AS pmid, publication_year AS y, coalesce(confidence, 0) AS c, coalesce(nullif(polarity, ''), 'positive') AS pol
  FROM relations
), ev AS (
  SELECT *, CASE WHEN pol = 'negative' THEN 'negative' WHEN p IN ({_in(vocab.BIOLOGICAL_PREDICATES)}) THEN 'biological' ELSE 'semantic' END AS layer FROM ev0 WHERE s <> '' AND o <> '' AND s <> o
), ends AS (
  SELECT s AS node, sl AS label, st AS kind, ord * 2 AS k FROM ev UNION ALL SELECT o, ol, ot, ord * 2 + 1 FROM ev
), nodes AS (
  SELECT node, arg_min(label, k) AS label, coalesce(arg_min(kind, k) FILTER (kind <> 'OTHER'), 'OTHER') AS entity_type FROM ends GROUP BY node
)"""


def _edges(name: str, source: str) -> str:
    return f""", {name}_p AS (SELECT layer, s, o, p, count(*) AS n, min(ord) AS f FROM {source} GROUP BY ALL)
, {name}_m AS (SELECT layer, s, o, pmid, min(ord) AS f FROM {source} WHERE pmid <> '' GROUP BY ALL)
, {name}_a AS (SELECT layer, s, o, avg(c) AS c, string_agg(DISTINCT y::VARCHAR, ';' ORDER BY y::VARCHAR) AS years, max(y) AS ymax, count(y) AS ny, min(ord) AS f FROM {source} GROUP BY ALL)
, {name} AS (
  SELECT a.layer, a.s, a.o, (SELECT p FROM {name}_p q WHERE q.layer = a.layer AND q.s = a.s AND q.o = a.o ORDER BY n DESC, f LIMIT 1) AS predicate,
    (SELECT string_agg(p, ';' ORDER BY f) FROM {name}_p q WHERE q.layer = a.layer AND q.s = a.s AND q.o = a.o) AS predicates,
    coalesce((SELECT string_agg(pmid, ';' ORDER BY f) FROM {name}_m q WHERE q.layer = a.layer AND q.s = a.s AND q.o = a.o), '') AS pmids,
    (SELECT count(*) FROM {name}_m q WHERE q.layer = a.layer AND q.s = a.s AND q.o = a.o) AS npm,
    coalesce(years, '') AS years, ymax, ny, round(c, 6) AS c, f FROM {name}_a a
)"""


_EDGE_SELECT = "SELECT layer, s AS subject, o AS object, predicate, predicates, pmids, years, c AS confidence, round(ln(1 + npm) * c, 6) AS weight FROM {}"


def _und_sql(name: str, source: str, where: str) -> str:
    return f", {name} AS (SELECT DISTINCT node, nbr FROM (SELECT s AS node, o AS nbr FROM {source} WHERE {where} UNION ALL SELECT o, s FROM {source} WHERE {where}))"


def _gap_sql(und: str, pairs=None) -> str:
    types = "(" + " OR ".join(f"(x.entity_type = '{a}' AND y.entity_type = '{b}')" for a, b in sorted(gaps.allowed_pairs(pairs))) + ")"
    return f""", deg AS (SELECT node, count(*) AS d FROM {und} GROUP BY node)
, two AS (
  SELECT a.node AS a, b.node AS b, count(*) AS cn, coalesce(sum(CASE WHEN g.d > 1 THEN 1 / ln(g.d) END), 0) AS aa, sum(1.0::DOUBLE / g.d) AS ra
  FROM {und} a JOIN {und} b ON a.nbr = b.nbr AND a.node < b.node JOIN deg g ON g.node = a.nbr
  WHERE NOT EXISTS (SELECT 1 FROM {und} e WHERE e.node = a.node AND e.nbr = b.node) GROUP BY 1, 2
), sc0 AS (
  SELECT a, b, x.entity_type AS ta, y.entity_type AS tb, cn, aa, ra, cn::DOUBLE / (da.d + db.d - cn) AS j FROM two JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b JOIN deg da ON da.node = a JOIN deg db ON db.node = b WHERE {types}
), sc AS (
  SELECT *, round(0.35 * j + 0.25 * aa + 0.2 * ra + 0.2 * cn, 6) AS score, greatest(round(j, 10), round(aa, 10), round(ra, 10), cn::DOUBLE) AS top FROM sc0
), gap AS (
  SELECT *, CASE WHEN round(j, 10) = top THEN 'jaccard' WHEN round(aa, 10) = top THEN 'adamic_adar' WHEN round(ra, 10) = top THEN 'resource_allocation' ELSE 'common_neighbors' END AS method FROM sc
)"""


def _gap_query(k: int, cutoff: int | None, pairs=None) -> str:
    """The k best gaps with their evidence; edges: ed."""
    told = "TRUE" if cutoff is None else f"n.ymin <= {cutoff}"
    bio = "layer = 'biological'" if cutoff is None else f"layer = 'biological' AND ny > 0 AND ymax <= {cutoff}"
    return (
        _EV + _edges("ed0", "ev") + f", ed AS (SELECT * FROM ed0 WHERE {bio})" + _und_sql("und", "ed", "TRUE") + _gap_sql("und", pairs)
        + f""", best AS (SELECT * FROM gap ORDER BY score DESC, a, b LIMIT {k})
, nb AS (SELECT best.a, best.b, x.nbr FROM best JOIN und x ON x.node = best.a JOIN und y ON y.node = best.b AND y.nbr = x.nbr)
, ids AS (SELECT nb.a, nb.b, count(DISTINCT m.pmid) AS n_pmids FROM nb JOIN ed e ON e.s = nb.nbr OR e.o = nb.nbr JOIN ed0_m m ON m.layer = e.layer AND m.s = e.s AND m.o = e.o GROUP BY 1, 2)
, ys AS (SELECT nb.a, nb.b, max(e.ymax) AS max_year FROM nb JOIN ed e ON e.s = nb.nbr OR e.o = nb.nbr GROUP BY 1, 2)
, neg AS (SELECT s, o, min(y) AS ymin FROM ev WHERE layer = 'negative' GROUP BY 1, 2)
, gaps AS (
  SELECT best.a AS node_a, best.b AS node_b, ta AS node_a_type, tb AS node_b_type, score, method,
    (SELECT string_agg(nbr, ';' ORDER BY nbr) FROM nb WHERE nb.a = best.a AND nb.b = best.b) AS common_neighbors,
    CASE WHEN EXISTS (SELECT 1 FROM neg n WHERE ((n.s = best.a AND n.o = best.b) OR (n.s = best.b AND n.o = best.a)) AND {told}) THEN 'CONTRADICTED' ELSE 'PARTIALLY_SUPPORTED' END AS novelty_status,
    coalesce(ids.n_pmids, 0) AS n_pmids, ys.max_year
  FROM best LEFT JOIN ids ON ids.a = best.a AND ids.b = best.b LEFT JOIN ys ON ys.a = best.a AND ys.b = best.b
) """
    )


_GAP_SELECT = "SELECT node_a, node_b, node_a_type, node_b_type, score, method, common_neighbors, novelty_status, n_pmids, max_year FROM gaps"

_BODY = rf"concat_ws(' ', nullif({_outer('title')}, ''), nullif({_outer('abstract')}, ''))"


def _list_sql(c: str) -> str:
    """Normalised distinct items in the order of their first place."""
    item = _norm("u.v")
    return f"(SELECT coalesce(string_agg(v, ';' ORDER BY p), '') FROM (SELECT {item} AS v, min(u.p) AS p FROM (SELECT unnest({c}) AS v, generate_subscripts({c}, 1) AS p) u WHERE u.v IS NOT NULL GROUP BY 1) w WHERE v <> '')"


def _same_case(x: str) -> str:
    return _collapse(f"nfc_normalize(coalesce({x}, ''))")


def _list_same_case(c: str) -> str:
    """Distinct items in the order of their first place, letter case kept."""
    return f"(SELECT coalesce(list(v ORDER BY p), []) FROM (SELECT {_same_case('u.v')} AS v, min(u.p) AS p FROM (SELECT unnest({c}) AS v, generate_subscripts({c}, 1) AS p) u WHERE u.v IS NOT NULL GROUP BY 1) w WHERE v <> '')"


#: Cleaned articles with their letter case.
_CLEANED = f"""SELECT article_ord, pmid, {_same_case('title')} AS title, {_same_case('abstract')} AS abstract, CASE WHEN year BETWEEN 1900 AND {THIS_YEAR + 1} THEN year END AS year FROM articles
  WHERE regexp_full_match(pmid, '[0-9]{{1,8}}') AND ({_norm('title')} <> '' OR {_norm('abstract')} <> '') QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY article_ord) = 1"""


def _xml_scan_sql() -> str:
    legal = lambda x: f"regexp_replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), '{_ILLEGAL}', '', 'g')"
    clean = lambda x: rf"regexp_replace(replace({legal(x)}, chr(13), chr(10)), '^{_W}|{_W}$', '', 'g')"
    items = lambda c: f"list_filter({c}, lambda x: x IS NOT NULL)"
    said = lambda c: f"list_filter(list_transform(coalesce({items(c)}, []), lambda x: {clean('x')}), lambda x: x <> '')"
    year = "CASE WHEN length(year::VARCHAR) = 4 AND year > 0 THEN CASE WHEN year BETWEEN 1900 AND {0} THEN year END ELSE 2001 END".format(THIS_YEAR + 1)
    mesh = f"flatten(list_transform(coalesce({items('mesh_terms')}, []), lambda x, i: CASE WHEN {clean('x')} = '' THEN [] WHEN i % 2 = 0 THEN [concat({clean('x')}, ' / one'), concat({clean('x')}, ' / two')] ELSE [{clean('x')}] END))"
    return f"""SELECT {clean('pmid')} AS pmid, {clean('title')} AS title, concat_ws(chr(10), 'METHODS: ' || nullif({clean('abstract')}, ''), nullif({clean('journal')}, '')) AS abstract, {said('authors')} AS authors, {clean('journal')} AS journal,
      {year} AS year, {mesh} AS mesh_terms, {said('keywords')} AS keywords, CASE article_ord % 3 WHEN 0 THEN nullif({clean('doi')}, '') WHEN 1 THEN concat('10.1/', article_ord) END AS doi
      FROM articles WHERE regexp_full_match({clean('pmid')}, '\\p{{Nd}}{{1,8}}')"""


def _export_sql() -> str:
    """Lines of the GraphML document; edges: ed."""

    def html(x: str) -> str:
        x = f"coalesce({x}, '')"
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
            x = f"replace({x}, '{a}', '{b}')"
        return x

    def data(**values: str) -> str:
        return ", ".join(f"""'<data key="{k}">', {html(v)}, '</data>'""" for k, v in values.items())

    head = ["<?xml version=''1.0'' encoding=''utf-8''?>", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{a}" attr.name="{k}" attr.type="{t}"/>' for k, a, t in [("label", "node", "string"), ("entity_type", "node", "string"), ("predicate", "edge", "string"), ("polarity", "edge", "string"), ("confidence", "edge", "double"), ("weight", "edge", "double"), ("pmids", "edge", "string"), ("years", "edge", "string")]]
    head.append('<graph edgedefault="directed">')
    fixed = ", ".join([f"(0, '{i:03d}', '{x}')" for i, x in enumerate(head)] + [f"(4, '{i:03d}', '{x}')" for i, x in enumerate(("</graph>", "</graphml>"))])
    edge = data(predicate="predicate", polarity="'positive'", confidence="c::VARCHAR", weight="round(ln(1 + npm) * c, 6)::VARCHAR", pmids="pmids", years="years")
    return f""", co AS (SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY s, o ORDER BY layer DESC) = 1)
SELECT * FROM (VALUES {fixed}) AS v(section, key, line)
UNION ALL SELECT 1, node, concat('<node id="', {html('node')}, '">', {data(label='label', entity_type='entity_type')}, '</node>') FROM nodes
UNION ALL SELECT 3, concat(s, chr(31), o), concat('<edge source="', {html('s')}, '" target="', {html('o')}, '">', {edge}, '</edge>') FROM co"""


def _hypothesis_sql() -> str:
    """Scored hypotheses of the gaps, evidence joined by subject and object."""

    def filled(text: str) -> str:
        out = "'" + text.replace("'", "''") + "'"
        for name, x in (("{a}", "node_a"), ("{b}", "node_b"), ("{via}", "via")):
            out = f"replace({out}, '{name}', {x})"
        return out

    t = hypotheses.TEMPLATES
    texts, feasible = "", ""
    for reverse in (False, True):
        for (x, y), parts in t.items():
            x, y = (y, x) if reverse else (x, y)
            when = f" WHEN node_a_type = '{x}' AND node_b_type = '{y}' THEN "
            texts += when + filled(parts[0])
            feasible += when + str(next((v for v, cues in vocab.FEASIBILITY if any(c in parts[3].lower() for c in cues)), vocab.FEASIBILITY_DEFAULT))
    other = next(v for v, cues in vocab.FEASIBILITY if any(c in hypotheses.DEFAULT_TEMPLATE[3].lower() for c in cues))
    kind = " ".join(f"WHEN {{0}} IN ({_in(m)}) THEN '{g}'" for g, m in vocab.TYPE_GROUPS.items())
    novelty = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.NOVELTY_SCORES.items())
    w = vocab.FINAL_WEIGHTS
    return f""", r AS (SELECT {_key('subject')} AS s, {_key('object')} AS o, coalesce(pmid, '') AS pmid, coalesce(sentence, '') AS t, publication_year AS y FROM relations)
, g AS (SELECT *, string_split(common_neighbors, ';') AS l FROM gaps)
, m AS (SELECT node_a, node_b, regexp_matches(t, '(?i)\\b(no association|not associated|no effect|did not|failed to|absence of|unrelated)\\b') AS con, pmid, t, y FROM g JOIN r ON s = node_a OR s = node_b OR o = node_a OR o = node_b
    WHERE ((node_a = s OR node_a = o) AND (node_b = s OR node_b = o)) OR list_contains(l, s) OR list_contains(l, o))
, c AS (SELECT node_a, node_b, count(DISTINCT (pmid, t, y)) FILTER (NOT con) AS n, count(DISTINCT (pmid, t, y)) FILTER (con) AS k, count(DISTINCT pmid) FILTER (NOT con) AS d FROM m GROUP BY 1, 2)
, h AS (SELECT g.*, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(d, 0) AS d, CASE {kind.format('node_a_type')} ELSE lower(node_a_type) END AS xa, CASE {kind.format('node_b_type')} ELSE lower(node_b_type) END AS xb,
    CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN concat(l[1], ' and ', l[2]) WHEN 3 THEN array_to_string(l, ', ') ELSE concat(array_to_string(l[1:3], ', '), ', and related intermediates') END AS via FROM g LEFT JOIN c USING (node_a, node_b))
, h2 AS (SELECT *, CASE WHEN k > 0 AND k >= n THEN 'CONTRADICTED' WHEN n >= 5 THEN 'KNOWN' WHEN n >= 3 THEN 'PARTIALLY_SUPPORTED' WHEN n >= 1 THEN 'INDIRECTLY_SUPPORTED' ELSE 'UNEXPLORED' END AS ns,
    greatest(0, least(1, least(n, 10) / 10 * 0.6::DOUBLE + d / greatest(n, 1) * 0.4::DOUBLE - least(k, 5) / 5 * 0.3::DOUBLE)) AS e,
    greatest(0, least(1, least(len(l), 5) / 5 + CASE WHEN (xa, xb) IN (('gene', 'disease'), ('disease', 'gene'), ('drug', 'gene'), ('gene', 'drug')) THEN 0.2::DOUBLE ELSE 0 END)) AS p, (CASE {feasible} ELSE {other} END)::DOUBLE AS f FROM h)
, h3 AS (SELECT *, (CASE ns {novelty} END)::DOUBLE AS v FROM h2)
SELECT md5(concat(node_a, ':', node_b, ':KLV53'))[1:12] AS hypothesis_id, node_a, node_b, CASE {texts} ELSE {filled(hypotheses.DEFAULT_TEMPLATE[0])} END AS hypothesis, novelty_status AS gap_novelty, ns AS novelty_status, n AS n_supporting, k AS n_contradicting,
    round(e, 6) AS evidence_score, v AS novelty_score, p AS plausibility_score, f AS feasibility_score, round({w['evidence_score']}::DOUBLE * e + {w['novelty_score']}::DOUBLE * v + {w['plausibility_score']}::DOUBLE * p + {w['feasibility_score']}::DOUBLE * f, 6) AS final_score, round((e + v + p) / 3, 6) AS mean_score FROM h3"""


def oracle_sql() -> dict[str, str]:
    low = "lower(sentence)"
    und_all = _und_sql("und", "ev", "layer <> 'negative'")
    und_bio = _und_sql("und", "ev", "layer = 'biological'")
    verb = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.inflections().items())
    base = " ".join(f"WHEN predicate = '{k}' THEN {v}" for k, v in vocab.CONFIDENCE_BASE.items())
    penalty = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.CERTAINTY_PENALTY.items())
    novelty = " ".join(f"WHEN '{k}' THEN {v}" for k, v in vocab.NOVELTY_SCORES.items())
    html = "title"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        html = f"replace({html}, '{a}', '{b}')"
    sup, con = "coalesce(len(supporting_evidence), 0)", "coalesce(len(contradicting_evidence), 0)"
    feasible = " ".join(f"WHEN {_any('lower(suggested_experiment)', cues)} THEN {v}" for v, cues in vocab.FEASIBILITY)
    bucket = "CASE WHEN confidence >= 0.7 THEN 'HIGH' WHEN confidence >= 0.4 THEN 'MODERATE' ELSE 'LOW' END"
    reach = _EV.replace("WITH ev0", "WITH RECURSIVE ev0", 1) + und_all + """, reach AS (SELECT node, node AS root FROM nodes UNION SELECT u.nbr, r.root FROM reach r JOIN und u ON u.node = r.node)
        , comp AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)"""
    return {
        "normalize_text": f"SELECT article_ord, {_norm('title')} AS title, {_norm('abstract')} AS abstract FROM articles",
        "truncate_text": "SELECT article_ord, CASE WHEN length(coalesce(title, '')) <= 40 THEN coalesce(title, '') ELSE concat(title[1:40], '…') END AS short FROM articles",
        "slugs": f"SELECT article_ord, {extraction_sql.slug("coalesce(title, '')")} AS slug FROM articles",
        "entity_classes": f"SELECT entity_id, {extraction_sql.entity_kind('text', _W)} AS kind, {extraction_sql.entity_norm("coalesce(text, '')", _W)} AS norm FROM entities",
        "entities_extract": extraction_sql.entities(_CLEANED, _W),
        "relations_extract": extraction_sql.relations(_CLEANED, _W),
        "p6_found": extraction_sql.nested(_W),
        "graph_export": _EV + _edges("ed", "(SELECT * FROM ev WHERE layer <> 'negative')") + _export_sql(),
        "xml_round_trip": f"""WITH f AS (SELECT * FROM articles WHERE regexp_full_match(pmid, '[0-9]{{1,8}}') AND ({_norm('title')} <> '' OR {_norm('abstract')} <> '') QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY article_ord) = 1)
            SELECT pmid, {_same_case('title')} AS title, {_same_case('abstract')} AS abstract, list_transform({_list_same_case('authors')}, lambda a: CASE WHEN contains(a, ',') THEN array_to_string(list_filter([trim(a[1:instr(a, ',') - 1]), trim(a[instr(a, ',') + 1:])], lambda x: x <> ''), ', ') ELSE a END) AS authors,
            {_same_case('journal')} AS journal, CASE WHEN year BETWEEN 1900 AND {THIS_YEAR + 1} THEN year END AS year, {_list_same_case('mesh_terms')} AS mesh_terms, {_list_same_case('keywords')} AS keywords, CASE WHEN doi <> '' THEN {_same_case('doi')} END AS doi FROM f""",
        "record_checks": f"SELECT article_ord, coalesce(regexp_full_match(pmid, '[0-9]{{1,8}}'), false) AS pmid_ok, CASE WHEN year BETWEEN 1900 AND {THIS_YEAR + 1} THEN year END AS year_ok, coalesce({html}, '') AS title_html FROM articles",
        "sentence_split": f"""WITH t AS (SELECT article_ord, {_collapse(_BODY)} AS x FROM articles), u AS (
            SELECT article_ord, list_filter(list_transform(string_split(regexp_replace(x, '([.!?;]) ([A-Z0-9])', concat('\\1', chr(1), '\\2'), 'g'), chr(1)), lambda v: trim(v)), lambda v: v <> '') AS l FROM t)
            SELECT article_ord, (generate_subscripts(l, 1) - 1)::INT AS sent_ord, unnest(l) AS sentence FROM u""",
        "cue_flags": f"""SELECT rel_ord, CASE WHEN sentence IS NULL THEN 'certain' WHEN {_any(low, vocab.SPECULATIVE_CUES)} THEN 'speculative' WHEN {_any(low, vocab.POSSIBLE_CUES)} THEN 'possible' WHEN {_any(low, vocab.PROBABLE_CUES)} THEN 'probable' ELSE 'certain' END AS certainty_cue,
            {_any(low, vocab.CONDITIONAL_CUES)} AS conditional, {_any('lower(sentence[1:40])', vocab.NEGATION_CUES)} AS negated_40 FROM relations""",
        "relation_confidence": f"""SELECT rel_ord, greatest(0, least(1, round(b - pen + 0.02 * sqrt(b), 3))) AS score, verb, edge_predicate FROM (
            SELECT rel_ord, (CASE {base} ELSE {vocab.CONFIDENCE_OTHER} END)::DOUBLE AS b, ((CASE certainty {penalty} ELSE 0.1 END) + (CASE polarity WHEN 'conditional' THEN 0.08 WHEN 'uncertain' THEN 0.05 ELSE 0 END))::DOUBLE AS pen,
            CASE lower(predicate) {verb} ELSE lower(predicate) END AS verb, replace({_key('predicate')}, ' ', '_') AS edge_predicate FROM relations)""",
        "evidence_lines": """SELECT rel_ord, concat('- ', coalesce(nullif(subject, ''), '?'), ' -> ', coalesce(nullif(object, ''), '?'), ' [', coalesce(nullif(predicate, ''), 'related_to'), '] PMID:', coalesce(nullif(pmid, ''), 'n/a'),
            CASE WHEN confidence IS NOT NULL THEN printf(' (%.2f)', confidence) ELSE '' END) AS line FROM relations""",
        "article_clean": f"""WITH v AS (SELECT * FROM articles WHERE regexp_full_match(pmid, '[0-9]{{1,8}}') AND ({_norm('title')} <> '' OR {_norm('abstract')} <> '')),
            f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY pmid ORDER BY article_ord) = 1)
            SELECT article_ord, pmid, {_norm('title')} AS title, {_norm('abstract')} AS abstract, {_list_sql('authors')} AS authors, {_norm('journal')} AS journal, CASE WHEN year BETWEEN 1900 AND {THIS_YEAR + 1} THEN year END AS year,
            {_list_sql('mesh_terms')} AS mesh_terms, {_list_sql('keywords')} AS keywords, CASE WHEN doi <> '' THEN {_norm('doi')} END AS doi FROM f""",
        "article_years": f"SELECT article_ord, year, {_BODY} AS body FROM articles WHERE year IS NULL OR year BETWEEN 2005 AND {CUTOFF}",
        "corpus_search": f"""SELECT article_ord, pmid FROM (SELECT *, {_norm("concat_ws(' ', title, abstract, journal, coalesce(array_to_string(keywords, ' '), ''), coalesce(array_to_string(mesh_terms, ' '), ''))")} AS hay FROM articles) WHERE contains(hay, 'klv53') AND contains(hay, 'pathway')""",
        "fetch_selected": "SELECT article_ord, pmid, year FROM articles WHERE pmid IN (SELECT pmid FROM relations WHERE polarity = 'conditional')",
        "relation_dedupe": """SELECT rel_ord, subject, predicate, object, pmid, polarity, confidence, first_ord FROM (SELECT *, min(rel_ord) OVER w AS first_ord, row_number() OVER (w ORDER BY confidence DESC, rel_ord) AS n FROM relations
            WINDOW w AS (PARTITION BY lower(subject), predicate, lower(object), pmid, polarity)) WHERE n = 1""",
        "edge_merge": _EV + _edges("ed", "(SELECT * FROM ev WHERE layer <> 'negative')") + _EDGE_SELECT.format("ed"),
        "temporal_layer": _EV + f", tv AS (SELECT * REPLACE ('temporal' AS layer) FROM ev WHERE layer = 'biological' AND y <= {CUTOFF})" + _edges("ed", "tv") + _EDGE_SELECT.format("ed"),
        "temporal_snapshot": _EV + _edges("ed", "(SELECT * FROM ev WHERE layer = 'biological')") + _EDGE_SELECT.format("ed") + f" WHERE ny > 0 AND ymax <= {CUTOFF}",
        "negative_edges": _EV + """, m AS (SELECT s, o, pmid, min(ord) AS f FROM ev WHERE layer = 'negative' AND pmid <> '' GROUP BY ALL)
            SELECT e.s AS subject, e.o AS object, arg_min(p, ord) AS predicate, count(*) AS n_relations, coalesce((SELECT string_agg(pmid, ';' ORDER BY f) FROM m WHERE m.s = e.s AND m.o = e.o), '') AS pmids,
            coalesce(string_agg(DISTINCT y::VARCHAR, ';' ORDER BY y::VARCHAR), '') AS years FROM ev e WHERE layer = 'negative' GROUP BY e.s, e.o""",
        "node_types": _EV + " SELECT node, label, entity_type FROM nodes",
        "combined_graph": _EV + _edges("ed", "(SELECT * FROM ev WHERE layer <> 'negative')") + " SELECT s AS subject, o AS object, layer, predicate, round(ln(1 + npm) * c, 6) AS weight FROM ed QUALIFY row_number() OVER (PARTITION BY s, o ORDER BY layer DESC) = 1",
        "degree_top10": _EV + und_all + " SELECT n.node, count(u.nbr) AS degree FROM nodes n LEFT JOIN und u ON u.node = n.node GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "degree_distribution": _EV + und_all + " SELECT degree, count(*) AS n FROM (SELECT n.node, count(u.nbr) AS degree FROM nodes n LEFT JOIN und u ON u.node = n.node GROUP BY 1) GROUP BY 1",
        "components": reach + " SELECT node, component FROM comp",
        "graph_stats": reach + """, d AS (SELECT count(*) AS ends FROM und), n AS (SELECT count(*) AS n FROM nodes),
            e AS (SELECT count(*) FILTER (layer = 'biological') AS b, count(*) FILTER (layer = 'semantic') AS m, count(*) FILTER (layer = 'negative') AS g FROM (SELECT DISTINCT layer, s, o FROM ev))
            SELECT n AS n_nodes, b + m AS n_edges, b AS n_biological_edges, m AS n_semantic_edges, ends / (n * (n - 1)) AS density, ends / n AS avg_degree,
            (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT node FROM und)) AS isolated_nodes_count, (SELECT count(DISTINCT component) FROM comp) AS connected_components, g AS negative_edge_count FROM n, d, e""",
        "repeated_edge_values": _EV + _edges("ed", "(SELECT * FROM ev WHERE layer <> 'negative')") + " SELECT layer, s AS subject, o AS object, split_part(predicates, ';', 1) AS predicate, 0 AS n_removed FROM ed",
        "edge_repeats_removed": _EV + _edges("ed", "(SELECT * FROM ev WHERE layer <> 'negative')") + """ SELECT layer, s AS subject, o AS object, split_part(predicates, ';', 1) AS predicate, predicates, pmids, years,
            (npm + length(predicates) - length(replace(predicates, ';', '')) + 1 + CASE WHEN years = '' THEN 0 ELSE length(years) - length(replace(years, ';', '')) + 1 END)::DOUBLE AS n_removed FROM ed""",
        "negative_confidences": _EV + " SELECT s AS subject, o AS object, c AS confidence, count(*) AS n FROM ev WHERE layer = 'negative' GROUP BY ALL",
        "incremental_edges": _EV + _edges("ed", "(SELECT * FROM ev WHERE layer <> 'negative')") + _EDGE_SELECT.format("ed"),
        "gap_scores": _EV + und_bio + _gap_sql("und") + " SELECT a AS node_a, b AS node_b, ta AS node_a_type, tb AS node_b_type, cn AS common_neighbors, round(j, 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS resource_allocation, score, method FROM gap",
        "gap_candidates_topk": _gap_query(20, None) + _GAP_SELECT,
        "gap_candidates_cutoff": _gap_query(20, CUTOFF) + _GAP_SELECT,
        "hop2_pairs": _EV + und_bio + " SELECT DISTINCT x.node AS node_a, y.nbr AS node_b FROM und x JOIN und y ON x.nbr = y.node AND x.node < y.nbr WHERE NOT EXISTS (SELECT 1 FROM und e WHERE e.node = x.node AND e.nbr = y.nbr)",
        "hop3_pairs": _EV + und_bio + """, h2 AS (SELECT DISTINCT x.node AS a, y.nbr AS b FROM und x JOIN und y ON x.nbr = y.node), h3 AS (SELECT DISTINCT h2.a, y.nbr AS b FROM h2 JOIN und y ON h2.b = y.node WHERE h2.a < y.nbr)
            SELECT a AS node_a, b AS node_b FROM h3 WHERE NOT EXISTS (SELECT 1 FROM und e WHERE e.node = a AND e.nbr = b) AND NOT EXISTS (SELECT 1 FROM h2 WHERE h2.a = h3.a AND h2.b = h3.b)""",
        "novelty_status": _EV + und_bio + f""", neg AS (SELECT s, o, min(y) AS ymin, count(DISTINCT nullif(pmid, '')) AS n FROM ev WHERE layer = 'negative' GROUP BY 1, 2)
            SELECT o AS node_a, s AS node_b, CASE WHEN EXISTS (SELECT 1 FROM und WHERE node = s AND nbr = o) THEN 'KNOWN'
              WHEN ymin <= {CUTOFF} OR EXISTS (SELECT 1 FROM neg m WHERE m.s = neg.o AND m.o = neg.s AND m.ymin <= {CUTOFF}) THEN 'CONTRADICTED'
              WHEN EXISTS (SELECT 1 FROM und x JOIN und y ON x.nbr = y.node WHERE x.node = neg.o AND y.nbr = neg.s) THEN 'PARTIALLY_SUPPORTED'
              WHEN EXISTS (SELECT 1 FROM und x JOIN und y ON x.nbr = y.node JOIN und z ON y.nbr = z.node WHERE x.node = neg.o AND z.nbr = neg.s) THEN 'INDIRECTLY_SUPPORTED'
              WHEN n < 2 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'UNEXPLORED' END AS novelty_status FROM neg""",
        "evidence_join": f"""WITH h AS (SELECT DISTINCT lower(entities[1]) AS a, lower(entities[2]) AS b FROM hypotheses WHERE len(entities) >= 2), r AS (
              SELECT {_key('subject')} AS s, {_key('object')} AS o, coalesce(pmid, '') AS pmid, coalesce(sentence, '') AS t, publication_year AS y FROM relations)
            SELECT a AS node_a, b AS node_b, regexp_matches(t, '(?i)\\b(no association|not associated|no effect|did not|failed to|absence of|unrelated)\\b') AS contradicts, count(DISTINCT (pmid, t, y)) AS n
            FROM h JOIN r ON (a = s OR a = o) AND (b = s OR b = o) WHERE a <> '' AND b <> '' GROUP BY ALL""",
        "hypothesis_generate": _gap_query(20, None) + _hypothesis_sql(),
        "run_metadata": _gap_query(50, None) + f"""SELECT (SELECT count(*) FROM articles) AS n_articles, (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM relations) AS n_relations,
            (SELECT count(*) FROM relations WHERE sentence <> '') AS n_evidence_claims, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT layer, s, o FROM ev WHERE layer <> 'negative')) AS n_edges,
            (SELECT count(*) FROM (SELECT DISTINCT s, o FROM ev WHERE layer = 'biological')) AS n_biological_edges, (SELECT count(*) FROM gaps) AS n_gaps, (SELECT count(*) FROM hypotheses) AS n_hypotheses,
            (SELECT concat(min(nullif(year, 0)), '–', max(nullif(year, 0))) FROM articles) AS years_covered, 'KLV53' AS query, {CUTOFF} AS cutoff_year""",
        "hypothesis_scores": f"""SELECT hypothesis_id, generated_at, round(greatest(0, least(1, least({sup}, 10) / 10 * 0.6::DOUBLE + len(list_distinct(list_transform(coalesce(supporting_evidence, []), lambda x: x.pmid))) / greatest({sup}, 1) * 0.4::DOUBLE - least({con}, 5) / 5 * 0.3::DOUBLE)), 6) AS evidence,
            (CASE upper(novelty_status) {novelty} ELSE 0.6 END)::DOUBLE AS novelty, (CASE {feasible} ELSE 0.5 END)::DOUBLE AS feasibility, {bucket} AS level,
            concat(repeat('█', round_even(least(1, greatest(0, confidence)) * 10, 0)::INT), repeat('░', 10 - round_even(least(1, greatest(0, confidence)) * 10, 0)::INT)) AS bar FROM hypotheses""",
        "hypothesis_order": "SELECT hypothesis_id, confidence FROM hypotheses ORDER BY coalesce(confidence, 0) DESC, hypothesis_id LIMIT 10",
        "hypothesis_places": "SELECT hypothesis_id, confidence, row_number() OVER (ORDER BY coalesce(confidence, 0) DESC, hypothesis_id) AS place FROM hypotheses",
        "hypothesis_averages": "SELECT count(*) AS n_hypotheses, round(avg(coalesce(final_score, 0)), 4) AS avg_final_score, round(avg(coalesce(evidence_score, 0)), 4) AS avg_evidence_score, round(avg(coalesce(novelty_score, 0)), 4) AS avg_novelty_score FROM hypotheses",
        "evidence_filter": f"""SELECT rel_ord, subject, predicate, object, confidence FROM relations WHERE contains(lower(concat_ws(' ', subject, object, predicate)), 'klv53') AND predicate IN ('activates', 'inhibits') AND lower(polarity) IN ('positive', 'negative')
            AND lower(certainty) = 'certain' AND (publication_year IS NULL OR publication_year = 0 OR publication_year BETWEEN 2005 AND {CUTOFF}) AND confidence >= 0.8""",
        "evidence_top": "SELECT rel_ord, confidence FROM relations ORDER BY coalesce(confidence, 0) DESC, rel_ord LIMIT 10",
        "evidence_places": "SELECT rel_ord, confidence, row_number() OVER (ORDER BY coalesce(confidence, 0) DESC, rel_ord) AS place FROM relations",
        "gap_filter": _gap_query(200, None) + "SELECT node_a AS entity_a, node_b AS entity_b, node_a_type AS entity_a_type, node_b_type AS entity_b_type, score, novelty_status, method, replace(common_neighbors, ';', '; ') AS common_neighbors, max_year FROM gaps WHERE score >= 0.7 AND (node_a_type = 'DISEASE' OR node_b_type = 'DISEASE')",
        "gap_sorts": _gap_query(50, None) + ", ".join(["SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{by}' AS sort, node_a, node_b, row_number() OVER (ORDER BY {order}) AS place FROM gaps" for by, order in (
                ("Score", "score DESC, node_a, node_b"), ("Novelty", "CASE novelty_status WHEN 'PARTIALLY_SUPPORTED' THEN 2 ELSE 5 END, score DESC, node_a, node_b"), ("Alphabetical", "lower(node_a), lower(node_b), score DESC")
            )
        ) + ")"]),
        "gap_other_pairs": _gap_query(20, None, OTHER_PAIRS) + _GAP_SELECT,
        "hypothesis_sorts": " UNION ALL ".join(f"SELECT '{c}' AS sort, hypothesis_id, row_number() OVER (ORDER BY coalesce({c}, 0) DESC, hypothesis_id) AS place FROM hypotheses" for c in _SORTS),
        "xml_scan": _xml_scan_sql(),
        "gap_figures": _gap_query(50, None) + "SELECT count(*) AS n_gaps, count(*) FILTER (score >= 0.7) AS n_high FROM gaps",
        "entity_type_counts": "SELECT entity_type, count(*) AS n FROM entities GROUP BY 1",
        "top_entities": "SELECT normalized, count(*) AS n FROM entities GROUP BY 1 ORDER BY 2 DESC, min(entity_id) LIMIT 10",
        "polarity_counts": "SELECT polarity, count(*) AS n FROM relations GROUP BY 1",
        "option_lists": " UNION ".join(f"SELECT '{c}' AS name, {c} AS value FROM relations WHERE {c} <> ''" for c in ("predicate", "polarity", "certainty", "subject_type")) + "".join(f" UNION SELECT 'end_type', {c} FROM relations WHERE {c} <> ''" for c in ("subject_type", "object_type")),
        "years_covered": "SELECT CASE WHEN min(nullif(year, 0)) IS NULL THEN 'N/A' WHEN min(nullif(year, 0)) = max(year) THEN max(year)::VARCHAR ELSE concat(min(nullif(year, 0)), '–', max(nullif(year, 0))) END AS years_covered FROM articles",
        "middle_year": "WITH y AS (SELECT list(DISTINCT publication_year ORDER BY publication_year) AS l FROM relations WHERE publication_year <> 0) SELECT l[len(l) // 2 + 1] AS middle_year FROM y",
        "relation_articles": "SELECT r.rel_ord, a.title FROM relations r LEFT JOIN (SELECT pmid, arg_max_null(title, article_ord) AS title FROM articles GROUP BY 1) a ON a.pmid = r.pmid",
    }
