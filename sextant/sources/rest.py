"""Documents from a web service, one request at a time on the executors, with each row's errors beside its data.

The transport is a function (endpoint, parameters) -> decoded JSON, so that tests and mirrors can stand in for the service.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Transport = Callable[[str, dict], dict]


def http(base: str, api_key: str, timeout: float = 60.0) -> Transport:
    def get(endpoint: str, parameters: dict) -> dict:
        query = urllib.parse.urlencode(parameters | {"api_key": api_key}, doseq=True)
        with urllib.request.urlopen(f"{base}/{endpoint}?{query}", timeout=timeout) as r:
            return json.load(r)

    return get


class Client:
    """Metadata of document keys, and their texts with annotations."""

    def __init__(self, transport: Transport, version: str):
        self.transport, self.version = transport, version

    def metadata(self, keys: list[str]) -> list[dict]:
        return self.transport("metadata", {"keys[]": keys, "version": self.version}).get("items", [])

    def texts(self, keys: list[str], translation: str | None = None) -> list[dict]:
        extra = {"translation": translation} if translation else {}
        return self.transport("texts_and_annotations", {"keys[]": keys, "version": self.version} | extra).get("items", [])

    def document(self, doc_key: str, translation: str | None = None) -> tuple[dict, list[dict]]:
        meta = self.metadata([doc_key])
        if not meta:
            raise LookupError(f"no metadata for {doc_key}")
        found = self.texts([meta[0]["manifesto_id"]], translation)
        if not found or not found[0].get("items"):
            raise LookupError(f"no text for {doc_key}")
        return meta[0], found[0]["items"]


SCHEMA = "doc_key string, manifesto_id string, language string, title string, items array<struct<text:string,cmp_code:string,eu_code:string>>, fetch_status string, fetch_error string"


def fetch_documents(keys: DataFrame, client: Client, column: str = "doc_key", translation: str | None = None) -> DataFrame:
    """One row for each key: what came, or status 'error' and why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch[column]:
                try:
                    meta, items = client.document(key, translation)
                    cut = [{k: None if i.get(k) is None else str(i[k]) for k in ("text", "cmp_code", "eu_code")} for i in items]
                    rows.append((key, str(meta.get("manifesto_id", "")), meta.get("language"), meta.get("title"), cut, "ok", None))
                except Exception as e:  # noqa: BLE001  any failure is this row's own
                    rows.append((key, None, None, None, [], "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.replace("array<struct<text:string,cmp_code:string,eu_code:string>>", "x").split(", ")])

    return keys.select(column).distinct().mapInPandas(run, SCHEMA)


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_key, manifesto_id, quasi_sentence_id from 0, text, cmp_code, eu_code) of the documents that came."""
    rows = documents.filter("fetch_status = 'ok'").select("doc_key", "manifesto_id", F.posexplode("items").alias("quasi_sentence_id", "i"))
    return rows.select("doc_key", "manifesto_id", "quasi_sentence_id", "i.text", "i.cmp_code", "i.eu_code")


def status(documents: DataFrame) -> DataFrame:
    """n_ok, n_error and ok, partial or error."""
    c = documents.agg(F.count_if(F.col("fetch_status") == "ok").alias("n_ok"), F.count_if(F.col("fetch_status") != "ok").alias("n_error"))
    return c.withColumn("run_status", F.when(F.col("n_error") == 0, "ok").when(F.col("n_ok") == 0, "error").otherwise("partial"))


def skipped(keys: DataFrame, column: str = "doc_key") -> DataFrame:
    """What fetch_documents gives where nothing is to be fetched: every key with status 'skipped'."""
    empty = keys.sparkSession.createDataFrame([], SCHEMA)
    return empty.unionByName(keys.select(F.col(column).alias("doc_key"), F.lit("skipped").alias("fetch_status")).distinct(), allowMissingColumns=True)
