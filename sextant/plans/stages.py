"""The study as a graph of stages for one country: each reads tables that earlier stages, or earlier runs, wrote, and writes its own."""

from __future__ import annotations

from argparse import Namespace
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import aggs, regression
from ..operators import topics as T
from ..sources import tei
from ..sources.files import read_csv, union_tables, write_csv
from . import alignment


@dataclass
class Country:
    """One country's run: where its tables are, and the options."""

    spark: SparkSession
    code: str
    name: str
    options: Namespace
    counts: dict[str, int] = field(default_factory=dict)

    def path(self, template: str) -> str:
        return template.format(code=self.code)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path(self.options.out)}/{table}")

    def write(self, table: str, df: DataFrame) -> None:
        where = f"{self.path(self.options.out)}/{table}"
        df.write.mode("overwrite").parquet(where)
        self.counts[table] = self.spark.read.parquet(where).count()

    def given(self, option: str) -> DataFrame:
        return self.spark.read.parquet(self.path(getattr(self.options, option)))

    def speeches(self) -> DataFrame:
        rows = alignment.regular_speeches(self.given("speeches") if self.options.skip_extract else self.read("extract"))
        return rows.withColumn("speech_no", F.xxhash64("party", "date", "text"))

    def catalogue(self) -> DataFrame:
        return read_csv(self.spark, self.options.catalogue).filter(F.col("countryname") == self.name)

    @property
    def model_path(self) -> str:
        return f"{self.path(self.options.out)}/model"


def extract(c: Country) -> None:
    o, found = c.options, {}
    for root in tei.corpus_roots(c.spark, c.path(o.corpus)):
        corpus, _ = tei.corpus_name(root)
        found[corpus] = tei.speeches(c.spark, root, corpus, o.unit, not o.no_notes, o.max_files)
    c.write("extract", union_tables(found, "corpus"))
    for corpus in found:
        write_csv(c.read("extract").filter(F.col("corpus") == corpus).drop("corpus"), f"{c.path(o.out)}/csv/{corpus}")


def party_mapping(c: Country) -> None:
    mapping = alignment.party_mapping(c.speeches(), c.catalogue(), country=c.code, country_name=c.name)
    c.write("mapping", mapping)
    for name, report in alignment.mapping_reports(c.read("mapping")).items():
        c.write(name, report)


def bridge(c: Country) -> None:
    c.write("bridge", alignment.date_bridge(c.speeches(), c.read("mapping"), alignment.programmes(c.catalogue(), c.name)))
    c.write("month_bridge", alignment.month_bridge(c.read("bridge"), "keep"))


def train(c: Country) -> None:
    o, rows = c.options, c.speeches()
    params = T.Params(o.topics_per_label, o.latent_topics, o.alpha, o.eta, o.min_cf, o.rm_top, o.seed)
    model = T.fit_labelled(rows, "speech_no", "text", "topic_label", ["date", "speech_no"], params, o.iterations)
    model.save(c.spark, c.model_path)
    shares = T.infer_labelled(rows.dropna(subset=["topic_label"]), "speech_no", "text", model, "topic_label")
    keyed = rows.select("speech_no", "party", "month", "month_start", X.word_count(F.col("text")).alias("word_count")).dropDuplicates(["speech_no"])
    c.write("speech_topics", shares.join(keyed, "speech_no"))
    c.write("topic_labels", c.spark.createDataFrame([(f"topic_{k}", name) for k, name in model.topics], "topic_column string, topic_label string"))


def distribution(c: Country) -> None:
    """What a plot of visible topics by party and month shows."""
    latent = c.options.latent_topics
    visible = V.normalized(F.slice("topics", 1, F.size("topics") - latent))
    c.write("topic_distribution", alignment.party_month_topics(c.read("speech_topics"), "unweighted").withColumn("topics", visible))


def weighted_topics(c: Country) -> None:
    c.write("party_month_topics", alignment.party_month_topics(c.read("speech_topics"), c.options.weighting))


def infer(c: Country) -> None:
    said = c.given("sentences").withColumn("sentence", F.concat_ws("#", "doc_key", F.col("quasi_sentence_id").cast("string")))
    model = T.LabelledModel.load(c.spark, c.model_path)
    found = T.infer_labelled(said, "sentence", "text", model, iterations=c.options.inference_iterations).join(said.select("sentence", "doc_key", "quasi_sentence_id"), "sentence")
    c.write("quasi_topics", found.withColumn("predicted_topic", F.concat(F.lit("topic_"), V.argmax(F.col("topics")).cast("string"))))
    c.write("manifesto_topics", aggs.as_vectors(aggs.mean_vector(c.read("quasi_topics"), ["doc_key"], "topics"), ["doc_key"], "topics"))


def align(c: Country) -> None:
    c.write("alignment", alignment.align(c.read("party_month_topics"), c.read("manifesto_topics"), c.read("month_bridge")))


def timeseries(c: Country) -> None:
    """What a plot of the scores over time shows."""
    c.write("timeseries", c.read("alignment").select("speech_party", F.coalesce("month_start", F.to_date(F.concat("month", F.lit("-01")))).alias("plot_date"), F.col(c.options.score).alias("score")).dropna().orderBy("speech_party", "plot_date"))


def panel(c: Country) -> None:
    c.write("panel", alignment.regression_panel(c.read("alignment"), c.speeches(), c.given("elections")))
    c.write("panel_model", alignment.model_columns(c.read("panel")))


def regress(c: Country) -> None:
    o, rows = c.options, c.read("panel")
    label = f"{o.outcome}_{o.weighting}"
    try:
        fit = regression.fit_ols(rows, o.outcome, list(o.predictors), ["speech_party"])
    except ValueError as e:  # too few rows for the parameters
        print(f"{c.code} {label}: {e}")
        return
    c.write(f"coefficients_{label}", c.spark.createDataFrame(fit.table, "term string, estimate double, std_error double, t_stat double, p_value double, ci_95_low double, ci_95_high double"))
    print(f"{c.code} {label}\n{fit.report()}")


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Country], None]
    needs: tuple[str, ...]
    makes: tuple[str, ...]
    skip: str | None = None  # the option that leaves it out


STAGES = (
    Stage("extract", extract, (), ("extract",), "skip_extract"),
    Stage("party-mapping", party_mapping, ("extract",), ("mapping", "unmapped_labels", "real_parties", "parliamentary_labels"), "skip_party_mapping"),
    Stage("manifesto-bridge", bridge, ("extract", "mapping"), ("bridge", "month_bridge"), "skip_manifesto_builder"),
    Stage("train", train, ("extract",), ("model", "speech_topics", "topic_labels")),
    Stage("topic-distribution", distribution, ("speech_topics",), ("topic_distribution",)),
    Stage("weighted-topics", weighted_topics, ("speech_topics",), ("party_month_topics",)),
    Stage("infer", infer, ("model",), ("quasi_topics", "manifesto_topics")),
    Stage("alignment", align, ("party_month_topics", "manifesto_topics", "month_bridge"), ("alignment",)),
    Stage("timeseries", timeseries, ("alignment",), ("timeseries",)),
    Stage("panel", panel, ("alignment", "extract"), ("panel", "panel_model"), "skip_regression"),
    Stage("regression", regress, ("panel",), (), "skip_regression"),
)


def chosen(options: Namespace) -> list[Stage]:
    """The stages that no option leaves out, in order."""
    return [s for s in STAGES if not (s.skip and getattr(options, s.skip))]


def run(country: Country) -> dict[str, int]:
    """Runs the chosen stages; returns the rows of each table written."""
    for stage in chosen(country.options):
        print(f"==> {country.code} {stage.name}")
        stage.run(country)
    return country.counts
