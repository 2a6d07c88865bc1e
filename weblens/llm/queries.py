"""Queries over the whole tables, one group a problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblens.llm.body import main_body, outside_body
from weblens.llm.cap import cap_contributors
from weblens.llm.common import site
from weblens.llm.leaks import leaks
from weblens.llm.lines import repeated_exact, repeated_near, without_lines
from weblens.llm import mojibake
from weblens.llm.mix import mixture
from weblens.llm.oracles import ORACLES  # noqa: F401
from weblens.llm.residue import residue_records
from weblens.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "search_hits")
    return cap_contributors(hits, site(F.col("url")), "hit_id", "_sem_score", cap=20)[1].select("hit_id")


def p1_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted sample of at most 20 hits a site and half a percent of all."""
    hits = table(spark, sf_dir, "search_hits")
    return cap_contributors(hits, site(F.col("url")), "hit_id", "_sem_score", cap=20, share=0.005, temperature=0.1, seed=7)[0]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_exact(table(spark, sf_dir, "research_sources"), "src_id", "final_url", "content")


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source without the lines of its site's near-duplicate clusters."""
    sources = table(spark, sf_dir, "research_sources").select("src_id", "final_url", "content")
    return without_lines(sources.dropDuplicates(["src_id"]), repeated_near(sources, "src_id", "final_url", "content"), "src_id", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_records(table(spark, sf_dir, "research_sources"), "src_id", "final_url", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside_body(table(spark, sf_dir, "fetched_pages"), "page_id", "final_url", "html", "content")


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_body(table(spark, sf_dir, "fetched_pages"), "page_id", "final_url", "html", "content")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_inexact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with up to two character edits in a window of ten words."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edits=2)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(table(spark, sf_dir, "documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restored(table(spark, sf_dir, "documents"))


#: Domains of the sources, the top of the budget tree.
DOMAINS = {
    source: domain
    for domain, sources in {
        "news": "fxdesk pasarkini ratewatch weltkurs marchefr bolsahoy rynekpl cambiobr lentaru",
        "reference": "apidocs paperindex repo_readmes pdf_reports handbook",
        "talk": "threadhub postfeed transcripts judged_answers",
        "records": "calendarfeed oddsboard cotdigest",
    }.items()
    for source in sources.split()
}


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), domains=DOMAINS, seed=11)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), domains=DOMAINS, seed=11)[1]


QUERIES = {"p1_found": p1_found, "p1_sampled": p1_sampled, "p2_found": p2_found, "p2_cleaned": p2_cleaned, "p3_found": p3_found}
QUERIES |= {"p4_found": p4_found, "p4_bodies": p4_bodies, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p6_found": p6_found, "p6_inexact": p6_inexact, "p8_found": p8_found, "p8_restored": p8_restored}

