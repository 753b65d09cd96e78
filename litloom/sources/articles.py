"""Article sources: JSON files, a built-in sample, search within a corpus, and a web service as a data source."""

from __future__ import annotations

import importlib
import json
import logging
import time
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from litloom.functions import text as X
from litloom.schemas import ARTICLE

from .xml import parse_document

log = logging.getLogger("litloom")


def load_json(spark: SparkSession, path: str, this_year: Column | None = None) -> DataFrame:
    """A file that is a list of articles, or an object whose ``articles`` is one.

    Entries that aren't objects are left out; values are taken as text; a missing file, invalid JSON or
    another top level raises. Parsed in the JVM as variants.
    """
    v = F.parse_json("value")
    kind = F.schema_of_variant("v")
    docs = spark.read.text(path, wholetext=True).select(v.alias("v"))
    items = F.when(kind.startswith("OBJECT"), F.expr("coalesce(try_variant_get(v, '$.articles', 'array<variant>'), array())")).when(kind.startswith("ARRAY"), F.expr("cast(v AS array<variant>)"))
    items = items.otherwise(F.raise_error(F.lit("the top level must be a list, or an object with 'articles'")).cast("array<variant>"))
    e = docs.select(F.posexplode(items).alias("article_ord", "e")).where(F.schema_of_variant("e").startswith("OBJECT"))

    def text(name: str) -> Column:
        return F.expr(f"coalesce(try_variant_get(e, '$.{name}', 'string'), '')")

    def texts(name: str) -> Column:
        return F.expr(f"coalesce(try_variant_get(e, '$.{name}', 'array<string>'), array())")

    return e.select(
        F.col("article_ord").cast("long"), X.collapse_outer(text("pmid")).alias("pmid"), text("title").alias("title"), text("abstract").alias("abstract"), texts("authors").alias("authors"), text("journal").alias("journal"),
        X.valid_year(text("year"), this_year).alias("year"), texts("mesh_terms").alias("mesh_terms"), texts("keywords").alias("keywords"), F.nullif(text("doi"), F.lit("")).alias("doi"),
    )


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Any JSON document or list of objects."""
    return spark.read.option("multiLine", "true").json(path)


SAMPLE = (
    ("30000001", "TP53 activates CDKN1A in breast cancer", "TP53 activates CDKN1A. Loss of TP53 was associated with breast cancer.", ["Ames, Ada", "Borg, Ben"], "Sample Oncology", 2021, ["Breast Neoplasms / genetics", "Apoptosis"], ["TP53", "CDKN1A", "breast cancer", "apoptosis"], "10.0000/s.1"),
    ("30000002", "MDM2 inhibits TP53", "MDM2 inhibits TP53 in melanoma. BRCA1 may activate TP53.", ["Cole, Cy", "Dahl, Di"], "Sample Genetics", 2022, ["Melanoma"], ["MDM2", "TP53", "melanoma", "BRCA1"], None),
    ("30000003", "BRCA1 targets RAD51", "BRCA1 targets RAD51. RAD51 is activated by ATM1.", ["Egge, Eli", "Falk, Fay", "Gron, Gil"], "Sample Genetics", 2022, ["DNA Repair"], ["BRCA1", "RAD51", "ATM1", "repair"], "10.0000/s.3"),
    ("30000004", "Tamoxifen inhibits CDK4", "Tamoxifen inhibits CDK4 in breast cancer. CDK4 correlates with proliferation.", ["Holt, Hans", "Iden, Ida"], "Sample Pharmacology", 2023, ["Tamoxifen / pharmacology"], ["tamoxifen", "CDK4", "breast cancer", "proliferation"], "10.0000/s.4"),
    ("30000005", "JAK2 requires STAT3", "JAK2 requires STAT3 for the STAT pathway. STAT3 binds to CDK4.", ["Juul, Jo", "Krag, Kim"], "Sample Signalling", 2024, ["Signal Transduction"], ["JAK2", "STAT3", "signaling", "CDK4"], None),
)


def sample_articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *a) for i, a in enumerate(SAMPLE)], "article_ord long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARTICLE))


def search(articles: DataFrame, query: str, max_results: int | None = None, order: str = "article_ord") -> DataFrame:
    """Articles whose normalised text holds every word of the query as a substring, in corpus order.

    An empty query means all; max_results of None or 0 means no limit."""
    hay = X.normalize_text(F.concat_ws(" ", "title", "abstract", "journal", F.array_join(F.coalesce("keywords", F.array()), " "), F.array_join(F.coalesce("mesh_terms", F.array()), " ")))
    words = F.array_distinct(F.filter(F.split(X.normalize_text(F.lit(query)), " "), lambda w: w != ""))
    out = articles.withColumn("_hay", hay).where(F.forall(words, lambda w: F.contains(F.col("_hay"), w))).drop("_hay")
    return out.orderBy(order).limit(max_results) if max_results else out


def fetch(articles: DataFrame, pmids: DataFrame) -> DataFrame:
    """The articles of some pmids."""
    return articles.join(pmids.select("pmid").distinct(), "pmid", "left_semi")


# --- web service ----------------------------------------------------------------------------------

SERVICE = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/"
RETRY_DELAYS = (1.0, 2.0)


def http_get(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read().decode("utf-8")


class Client:
    """Search and fetch through ``get(url, timeout)``, no faster than the interval allows."""

    def __init__(self, get: Callable[[str, float], str] = http_get, email: str = "", api_key: str = "", interval: float = 0.0, sleep=time.sleep, clock=time.monotonic) -> None:
        self.get, self.email, self.api_key, self.interval, self.sleep, self.clock, self.last = get, email, api_key, interval, sleep, clock, None

    def _call(self, name: str, timeout: float, **params: str) -> str:
        if self.last is not None and (wait := self.last + self.interval - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        params |= {k: v for k, v in (("email", self.email), ("api_key", self.api_key)) if v}
        return self.get(SERVICE + name + "?" + urllib.parse.urlencode(params), timeout)

    def search(self, query: str, max_results: int) -> list[str]:
        """Valid ids by relevance; blank queries and errors of any kind give none."""
        if not (query or "").strip():
            return []
        try:
            found = json.loads(self._call("esearch.fcgi", 30, db="pubmed", term=query, retmax=str(max_results), retmode="json", sort="relevance"))
            return [i for i in found.get("esearchresult", {}).get("idlist", []) if isinstance(i, str) and i.isdecimal() and len(i) <= 8]
        except Exception as error:  # noqa: BLE001
            log.error("search failed: %s", error)
            return []

    def fetch(self, pmids: list[str]) -> str:
        body = self._call("efetch.fcgi", 60, db="pubmed", id=",".join(pmids), retmode="xml")
        if not body.strip():
            raise ValueError("empty answer")
        return body

    def fetch_or_drop(self, pmids: list[str]) -> str:
        """Three attempts; a batch that fails them all is dropped."""
        for delay in (*RETRY_DELAYS, None):
            try:
                return self.fetch(pmids)
            except Exception as error:  # noqa: BLE001
                if delay is None:
                    log.error("batch dropped: %s", error)
                else:
                    self.sleep(delay)
        return ""


class _Batches(InputPartition):
    """All batches: one task asks for them one after another, so that the service's limit holds for all of them."""

    def __init__(self, batches: list[list[str]]) -> None:
        super().__init__(batches)
        self.batches = batches


def _named(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = options

    def _client(self) -> Client:
        return Client(_named(self.o["transport"]) if "transport" in self.o else http_get, self.o.get("email", ""), self.o.get("apikey", ""), float(self.o.get("interval", "0.34")))

    def partitions(self) -> list[InputPartition]:
        size = int(self.o.get("batchsize", "100"))
        ids = self._client().search(self.o.get("query", ""), int(self.o.get("maxresults", "200")))
        return [_Batches([ids[i : i + size] for i in range(0, len(ids), size)])]

    def read(self, partition: _Batches):
        client, done, total = self._client(), 0, sum(map(len, partition.batches))
        tell = _named(self.o["progress"]) if "progress" in self.o else None
        for pmids in partition.batches:
            yield from parse_document(client.fetch_or_drop(pmids))
            done += len(pmids)
            if tell is not None:
                tell(done, total)


class ArticleService(DataSource):
    """spark.read.format("litloom_articles").options(query=..., batchSize=..., transport="module:function").load()

    progress="module:function": called with the ids asked for so far and in all, after each batch."""

    @classmethod
    def name(cls) -> str:
        return "litloom_articles"

    def schema(self):
        return ARTICLE

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArticleService)


def retrieve_and_clean(spark: SparkSession, query: str, settings, max_results: int | None = None, transport: str | None = None, **cleaning) -> DataFrame:
    """Articles of a query from the service, cleaned; with the order in which they came."""
    from litloom.operators.clean import clean_articles

    register(spark)
    options = {"query": query, "maxResults": str(max_results or settings.max_results), "batchSize": str(settings.batch_size), "email": settings.entrez_email, "apiKey": settings.entrez_api_key, "interval": str(settings.min_interval)}
    if transport:
        options["transport"] = transport
    found = spark.read.format("litloom_articles").options(**options).load()
    return clean_articles(found.withColumn("article_ord", F.monotonically_increasing_id()), **cleaning)
