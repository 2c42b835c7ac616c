"""The registered queries of this folder: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, chunking, ftrl, linecrf, maintext, mixing, phrases, pieces, simhash, spelling, substrings, urls, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(job: Query) -> Query:
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query("op1_mix_sources")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Sources weighted 5, 2, 1, repeating; at most three passes over any source."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    mixed = mixing.with_mix(docs, mixing.plan(docs, weights=(5, 2, 1), most=3))
    return mixed.select("doc_id", *[F.col(f"_mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash of three-word shingles; fingerprints link at two or fewer differing bits."""
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=3)


@query("op5_substring_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Words covered by a repeated window of 35 words go."""
    return substrings.digests(table(spark, sf, "documents"))


@query("op9_chunk_fingerprints")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts."""
    return chunking.edit_report(table(spark, sf, "documents"))


@query("op7_ftrl_quality")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """A quality score of every text, learnt from the labels that aren't held out."""
    docs = table(spark, sf, "documents")
    return ftrl.scored(docs, ftrl.train(docs, table(spark, sf, "labels")))


@query("op8_line_crf_rules")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts of every text, and the verdict of its lines."""
    docs = table(spark, sf, "documents")
    return linecrf.verdicts(docs, linecrf.train(docs, table(spark, sf, "labels")))


#: The policy of op4; the longest rule that fits decides.
RULES = [
    urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


@query("op4_url_filter")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Rules, and where none fits a model learnt from URLs that a rule decides."""
    pages = table(spark, sf, "pages")
    return urls.verdicts(pages, RULES, urls.fit(urls.labelled_by_rules(pages, RULES)))


@query("op10_chat_snapshots", chats.ORACLE)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal conversations of the log, rendered."""
    return chats.rendered(table(spark, sf, "conversations"))


@query("op3_warc_derivatives")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derivatives(warc.responses(table(spark, sf, "pages")))


@query("op6_gumbel_segmentations")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Two sampled segmentations of every whole text."""
    return pieces.segmentations(table(spark, sf, "documents"), samples=2)


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Words one edit apart, and the frequent word each stands for."""
    return spelling.variants(table(spark, sf, "documents"))


@query("op13_main_text")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every whole page."""
    return maintext.main_text(table(spark, sf, "pages"))


@query("op11_phrase_collocations", phrases.ORACLE)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return phrases.collocations(table(spark, sf, "documents"))
