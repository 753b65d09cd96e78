"""Sources, sinks, cleaning, streaming and flattening of nested records."""

import json
import random
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litloom.operators import clean, graph, nested
from litloom.plans.pipeline import Pipeline
from litloom.sources import articles as sources
from litloom.sources import sinks, xml
from litloom.sources.config import Settings
from litloom.streaming import ingest

ART = "article_ord long, pmid string, title string, abstract string, authors array<string>, journal string, year int, mesh_terms array<string>, keywords array<string>, doi string"


def art(i, pmid, title="t", abstract="a", year=2020, **more):
    return (i, pmid, title, abstract, more.get("authors"), more.get("journal"), year, more.get("mesh"), more.get("keywords"), more.get("doi"))


def test_cleaning(spark):
    rows = [art(0, "1"), art(1, "1"), art(2, "2", "", " "), art(3, "3"), art(4, "100", "Title A", year=2020), art(5, "100", "Title B", year=2021), art(6, "7", None, None), art(7, "7", "Seen"), art(8, "x"), art(9, None), art(10, "9", "É", authors=["Ann ", "ann", None, "", "É"], year=1800, doi="")]
    got = {r.pmid: r for r in clean.clean_articles(spark.createDataFrame(rows, ART), this_year=F.lit(2026)).collect()}
    assert set(got) == {"1", "3", "100", "7", "9"}
    assert (got["100"].title, got["100"].year, got["7"].title, got["9"].authors, got["9"].year, got["9"].doi, got["9"].keywords) == ("title a", 2020, "seen", ["ann", "é"], None, None, [])
    again = clean.clean_articles(spark.createDataFrame(list(got.values()), ART)).collect()
    assert sorted(again) == sorted(got.values())
    assert clean.clean_articles(spark.createDataFrame([], ART)).count() == 0
    w = spark.createDataFrame(rows, ART)
    assert clean.year_window(w, 2021).count() == 1 and clean.year_window(w).count() == len(rows)
    with pytest.raises(ValueError):
        clean.check_years(2020, 2010)


FULL = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>99999999</PMID><Article><ArticleTitle>a <i>b</i> c</ArticleTitle>
<Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText> </AbstractText><AbstractText>y</AbstractText></Abstract>
<AuthorList><Author><LastName>Smith</LastName><ForeName>John</ForeName></Author><Author><CollectiveName>Group</CollectiveName></Author><Author/></AuthorList>
<Journal><Title>J</Title><JournalIssue><PubDate><Year>2022</Year></PubDate></JournalIssue></Journal><ELocationID EIdType="DOI">d2</ELocationID></Article>
<MeshHeadingList><MeshHeading><DescriptorName>D</DescriptorName><QualifierName>q</QualifierName><QualifierName>r</QualifierName></MeshHeading><MeshHeading><DescriptorName>E</DescriptorName></MeshHeading></MeshHeadingList>
<KeywordList><Keyword>k</Keyword><Keyword> </Keyword></KeywordList></MedlineCitation></PubmedArticle>{more}</PubmedArticleSet>"""
STOP = "<PubmedArticle><MedlineCitation><PMID>5</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1850 Jan</MedlineDate></PubDate></JournalIssue></Journal><ArticleDate><Year>2020</Year></ArticleDate></Article></MedlineCitation></PubmedArticle>"
BAD = "<PubmedArticle><MedlineCitation><PMID>x</PMID><Article/></MedlineCitation></PubmedArticle><PubmedArticle/>"


def test_xml(spark, tmp_path):
    docs = spark.createDataFrame([(FULL.format(more=STOP + BAD),), ("",), (None,), ("<a><b></a>",)], "xml string")
    got = {r.pmid: r for r in xml.parse_xml(docs, limit=2027).collect()}
    assert set(got) == {"99999999", "5"}
    r = got["99999999"]
    assert (r.title, r.abstract, r.authors, r.journal, r.year, r.mesh_terms, r.keywords, r.doi) == ("a b c", "AIM: x\ny", ["Smith, John", "Group"], "J", 2022, ["D / q", "D / r", "E"], ["k"], "d2")
    assert got["5"].year is None and got["5"].abstract == ""
    (tmp_path / "x.xml").write_text(FULL.format(more=STOP))
    assert xml.read_xml(spark, str(tmp_path), 2027).count() == 2
    assert {r.pmid for r in xml.read_xml_records(spark, str(tmp_path), 2027).collect()} == {"99999999", "5"}


def test_xml_round_trip(spark):
    a = sources.sample_articles(spark)
    back = xml.parse_xml(xml.to_xml(a), limit=2027)
    assert sorted(back.collect()) == sorted(a.drop("article_ord").collect())


def test_json(spark, tmp_path):
    p = tmp_path / "a.json"
    one = {"pmid": 50001, "title": "T", "year": "2020", "authors": ["x"], "doi": ""}
    for payload in ([one, 7, "s"], {"articles": [one]}):
        p.write_text(json.dumps(payload))
        r = sources.load_json(spark, str(p), F.lit(2026)).collect()
        assert [(x.pmid, x.title, x.year, x.authors, x.keywords, x.doi) for x in r] == [("50001", "T", 2020, ["x"], [], None)]
    for bad in ("7", "{"):
        p.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            sources.load_json(spark, str(p)).collect()
    with pytest.raises(Exception):  # noqa: B017
        sources.load_json(spark, str(tmp_path / "none.json")).collect()


def test_search_and_fetch(spark):
    a = sources.sample_articles(spark)
    assert [r.pmid for r in sources.search(a, " BREAST cdk4 ").collect()] == ["30000004"]
    assert sources.search(a, "").count() == 5 and sources.search(a, "tp53", 1).count() == 1 and sources.search(a, "nothing-here").count() == 0
    assert sources.fetch(a, spark.createDataFrame([("30000001",), ("30000001",)], "pmid string")).count() == 1


def fake_get(url, timeout):
    if "esearch" in url:
        return json.dumps({"esearchresult": {"idlist": ["99999999", "5", "bad"]}})
    return FULL.format(more=STOP)


def test_client_retries_and_waits():
    calls, waits = [], []

    def failing(url, timeout):
        calls.append(url)
        raise OSError("down")

    c = sources.Client(failing, interval=.5, sleep=waits.append, clock=lambda: 0.0)
    assert c.fetch_or_drop(["1"]) == "" and len(calls) == 3 and waits == [1.0, .5, 2.0, .5]
    assert c.search("x", 3) == [] and sources.Client(fake_get).search(" ", 3) == []
    assert sources.Client(fake_get).search("x", 3) == ["99999999", "5"]


def test_service_source(spark):
    sources.register(spark)
    df = spark.read.format("litloom_articles").options(query="q", batchSize="1", transport="tests.test_sources:fake_get", interval="0").load()
    assert df.count() == 4  # two batches, each answered with both records


def test_retrieve_and_clean(spark, tmp_path):
    got = sources.retrieve_and_clean(spark, "q", Settings(), transport="tests.test_sources:fake_get", this_year=F.lit(2026)).collect()
    assert [(r.pmid, r.title) for r in got] == [("99999999", "a b c")]  # the other record has no text
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sources.read_json(spark, str(tmp_path / "x.json")).count() == 2


def test_settings():
    s = Settings.from_env({"MAX_RESULTS": "7", "BATCH_SIZE": "x", "HISTORICAL_CUTOFF_YEAR": "3000", "ENTREZ_API_KEY": "k"}, 2026)
    assert (s.max_results, s.batch_size, s.historical_cutoff_year, s.min_interval) == (7, 100, None, .1)
    assert Settings.from_env({"HISTORICAL_CUTOFF_YEAR": "2019"}, 2026).historical_cutoff_year == 2019 and Settings().min_interval == 1 / 3


def test_sinks(spark, tmp_path):
    p = Pipeline(sources.sample_articles(spark), "TP53", preserve_case=True)
    g = graph.combined(graph.merge_edges(p.evidence))
    nodes = graph.nodes(p.evidence)
    sinks.write_lines(sinks.graphml(nodes, g), str(tmp_path / "g"))
    text = "\n".join(r.value for f in sorted((tmp_path / "g").glob("part-*")) for r in spark.read.text(str(f)).collect())
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert len(ET.fromstring(text.split("\n", 1)[1]).findall(f"{ns}graph/{ns}edge")) == g.count()
    sinks.write_lines(sinks.node_link(nodes, g), str(tmp_path / "n"))
    doc = json.loads("\n".join(r.value for f in sorted((tmp_path / "n").glob("part-*")) for r in spark.read.text(str(f)).collect()))
    assert len(doc["nodes"]) == nodes.count() and len(doc["links"]) == g.count()
    sinks.write_gaps_csv(p.gaps, str(tmp_path / "c"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "c")).columns) == sinks.GAP_COLUMNS or p.gaps.isEmpty()
    sinks.export_all(str(tmp_path / "all"), p.corpus, p.relations, p.gaps, p.hypotheses(), p.metadata())
    assert spark.read.json(str(tmp_path / "all/articles")).count() == 5 and spark.read.json(str(tmp_path / "all/metadata")).first().n_articles == 5
    sinks.write_json(spark.createDataFrame([([5, 4, 5],)], "x array<int>"), str(tmp_path / "j"), ("x",))
    assert spark.read.json(str(tmp_path / "j")).first().x == [4, 5]
    assert sinks.as_columns(spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")) == {"i": [1, 2], "s": ["a", "b"]}


def test_cache(spark, tmp_path):
    made = []

    @sinks.cached(str(tmp_path))
    def numbers(spark, n):
        made.append(n)
        return spark.range(n)

    assert [numbers(spark, n).count() for n in (3, 3, 4)] == [3, 3, 4] and made == [3, 4]


def test_pipeline_cleaned_and_raw(spark):
    a = sources.sample_articles(spark)
    cleaned, raw = Pipeline(a, "q"), Pipeline(a, "q", cleaned=False, intended=True)
    assert raw.relations.count() > cleaned.relations.count()  # capitals are lost by cleaning
    h = raw.hypotheses().collect()
    assert len(h) == min(5, raw.gaps.count()) and all(0 <= r.final_score <= 1 for r in h)
    assert [r.final_score for r in h] == sorted((r.final_score for r in h), reverse=True)
    assert Pipeline(a.limit(0)).metadata().first().n_gaps == 0


def test_streaming(spark, tmp_path):
    a = sources.sample_articles(spark)
    (tmp_path / "in").mkdir()
    for i in range(2):
        a.where(f"article_ord % 2 = {i} or article_ord = 0").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = ingest.ingest(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/articles")).groupBy("pmid").count().where("count > 1").count() == 0
    whole = Pipeline(a, preserve_case=True)
    key = ["layer", "subject", "object", "n_relations", "confidence"]
    assert sorted(ingest.edges(spark, str(tmp_path / "out")).select(key).collect()) == sorted(graph.merge_edges(whole.evidence).select(key).collect())
    ingest.process(a.where("article_ord = 1"), 1, str(tmp_path / "out"))  # a batch run again replaces its outcome
    assert spark.read.parquet(str(tmp_path / "out/articles")).where("pmid = '30000002'").count() == 1


# --- nested records -------------------------------------------------------------------------------


def plain(payload):
    """The flattening by the standard library, for comparison."""
    try:
        root = json.loads(payload)
    except (ValueError, TypeError):
        return []
    if not isinstance(root, dict):
        return []

    def get(x, *path):
        for p in path:
            x = x.get(p) if isinstance(x, dict) else None
        return x

    def text(x):
        x = x.get("#text") if isinstance(x, dict) else x
        return x.strip() if isinstance(x, str) else ""

    def items(x):
        return [] if x is None else x if isinstance(x, list) else [x]

    out, c = [], get(root, "MedlineCitation")
    for i, a in enumerate(items(get(c, "Article", "AuthorList", "Author"))):
        g, last, first = (text(get(a, n)) for n in ("CollectiveName", "LastName", "ForeName"))
        out.append(("author", i, -1, g or ", ".join(x for x in (last, first) if x)))
        out += [("affiliation", i, j, text(get(x, "Affiliation"))) for j, x in enumerate(items(get(a, "AffiliationInfo")))]
    for i, h in enumerate(items(get(c, "MeshHeadingList", "MeshHeading"))):
        d, qs = text(get(h, "DescriptorName")), [(j, text(q)) for j, q in enumerate(items(get(h, "QualifierName")))]
        if d:
            out += [("mesh", i, j, f"{d} / {q}") for j, q in qs if q] or [("mesh", i, -1, d)]
    out += [("keyword", i, j, text(w)) for i, k in enumerate(items(get(c, "KeywordList"))) for j, w in enumerate(items(get(k, "Keyword")))]
    for path, kind in ((("PubmedData", "ArticleIdList", "ArticleId"), "IdType"), (("MedlineCitation", "Article", "ELocationID"), "EIdType")):
        dois = [x for x in items(get(root, *path)) if text(get(x, kind)).lower() == "doi"]
        if dois:
            out.append(("doi", 0, -1, text(dois[0])))
            break
    return sorted(o for o in out if o[3])


ODD = [None, "", "  ", "{}", "[]", '"s"', "null", '{"a":}', '{"a":1,}', '{"a":[1,],"b":2}', '{"a" 1}', '{"a":1}{"b":2}', '{"a":[}]', '{"a":01}', '{"a":tru}', '{"a":"\\x"}', '{,"a":1}', '{"a":1]', "}", '{"a":"b":"c"}', '{"a":"b","c"}', '{"a":"\n"}',
       '{"MedlineCitation":{"KeywordList":{"Keyword":["a\\"b","\\u00e9\\ud83d\\ude00",{"#text":" x "},"y\\\\",null,5]}}}', '{"MedlineCitation":{"KeywordList":{"Keyword":"p"},"KeywordList":{"Keyword":"q"}}}', '{"Med\\u006cineCitation":{"KeywordList":{"Keyword":"p"}}}']


def test_nested_against_standard_library():
    random.seed(3)
    base = json.dumps({"MedlineCitation": {"Article": {"AuthorList": {"Author": [{"LastName": "L", "ForeName": "F", "AffiliationInfo": [{"Affiliation": " "}, {"Affiliation": "A, \"q\" {x}"}]}, {"CollectiveName": {"#text": "C"}}, {}]}, "ELocationID": {"EIdType": "doi", "#text": "e"}},
                       "MeshHeadingList": {"MeshHeading": [{"DescriptorName": {"#text": "D"}, "QualifierName": ["", "q"]}, {"DescriptorName": "E"}, {"QualifierName": "z"}]}, "KeywordList": [{"Keyword": ["k", "é"]}, {}, {"Keyword": {"#text": "w"}}]},
                       "PubmedData": {"ArticleIdList": {"ArticleId": [{"IdType": "pubmed", "#text": "1"}, {"IdType": "DOI", "#text": " "}, {"IdType": "doi", "#text": "n"}]}}})
    docs = [*ODD, base, base.replace("DOI", "x"), "[" * 50 + "]" * 50, '{"a":' + "[" * 300 + "]" * 300 + "}"]
    for _ in range(1500):
        i = random.randrange(len(base))
        docs.append(base[:i] + random.choice(["", *'{}[],:"\\ 1a']) + base[i + 1 :])
    got = {}
    for d, *r in nested.flatten_payloads(pa.array(docs, pa.string())):
        got.setdefault(d, []).append(tuple(r))
    for i, p in enumerate(docs):
        assert sorted(got.get(i, [])) == plain(p), p
    assert nested.flatten_payloads(pa.array([], pa.string())) == []


def test_nested_table(spark):
    df = spark.createDataFrame([(1, ODD[-3], "x"), (2, None, "y"), (3, ODD[-3], None)], "raw_id long, payload string, child string")
    rows = nested.flatten(df).collect()
    assert len(rows) == 8 and {r.raw_id for r in rows} == {1, 3} and nested.flatten(df.limit(0)).count() == 0
