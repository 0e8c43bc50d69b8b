"""Command line: python -m sextant.cli --country CZ … runs the stages for one or more countries."""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Callable, Sequence


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sextant", description="Alignment of speeches with programmes, by country")
    p.add_argument("countries", nargs="+", help="codes, separated by spaces or commas; CODE=NAME sets the catalogue's name")
    p.add_argument("--corpus", default="{code}/corpus", help="folder of transcripts, for the extraction")
    p.add_argument("--speeches", default="{code}/speeches", help="Parquet folder of extracted speeches, where the extraction is skipped")
    p.add_argument("--skip-extract", action="store_true", help="read speeches instead of transcripts")
    p.add_argument("--skip-party-mapping", action="store_true", help="use the mapping of an earlier run")
    p.add_argument("--skip-manifesto-builder", action="store_true", help="use the bridge of an earlier run")
    p.add_argument("--skip-regression", action="store_true")
    p.add_argument("--unit", choices=["auto", "speech", "segment"], default="auto", help="unit of analysis of the extraction")
    p.add_argument("--max-files", type=int, help="transcripts to extract at most")
    p.add_argument("--no-notes", action="store_true", help="extract no notes")
    p.add_argument("--inference-iterations", type=int, default=100)
    p.add_argument("--score", default="alignment_score", help="column of the time series")
    p.add_argument("--outcome", default="alignment_score", help="left-hand side of the regression")
    p.add_argument("--predictors", nargs="+", default=["electoral_cycle_progress", "log1p_speech_words"])
    p.add_argument("--catalogue", default="catalogue.csv")
    p.add_argument("--sentences", default="{code}/sentences")
    p.add_argument("--elections", default="{code}/elections")
    p.add_argument("--out", default="out/{code}")
    p.add_argument("--weighting", choices=["unweighted", "word_count", "log_word_count"], default="log_word_count")
    p.add_argument("--topics-per-label", type=int, default=3)
    p.add_argument("--latent-topics", type=int, default=1)
    p.add_argument("--min-cf", type=int, default=3)
    p.add_argument("--rm-top", type=int, default=0)
    p.add_argument("--alpha", type=float, default=0.1)
    p.add_argument("--eta", type=float, default=0.01)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--iterations", type=int, default=240)
    p.add_argument("--pooled", action="store_true", help="a regression over all countries at the end, with country effects")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--continue-on-error", action="store_true")
    return p


def countries(items: Sequence[str]) -> dict[str, str]:
    """Ordered codes with the names they go by in the catalogue."""
    out: dict[str, str] = {}
    for item in (x for i in items for x in re.split(r"[,\s]+", i) if x):
        code, _, name = item.partition("=")
        out.setdefault(code.upper(), name or code.upper())
    return out


def run_all(codes: dict[str, str], stage: Callable[[str, str], object], continue_on_error: bool) -> tuple[dict[str, object], list[str]]:
    """What each country gave, and those that failed."""
    done, failed = {}, []
    for code, name in codes.items():
        try:
            done[code] = stage(code, name)
        except Exception as e:  # noqa: BLE001
            print(f"{code}: {e}", file=sys.stderr)
            failed.append(code)
            if not continue_on_error:
                break
    return done, failed


def main(argv: Sequence[str] | None = None) -> int:
    from .plans import stages

    a = parser().parse_args(argv)
    codes = countries(a.countries)
    if a.dry_run:
        for code, name in codes.items():
            print(f"{code} ({name}): {a.out.format(code=code)}: {' '.join(s.name for s in stages.chosen(a))}")
        return 0
    from .operators import regression
    from .plans import alignment
    from .session import get_spark

    spark = get_spark()

    def one(code: str, name: str) -> dict[str, int]:
        counts = stages.run(stages.Country(spark, code, name, a))
        print(f"{code}: " + ", ".join(f"{table} {n}" for table, n in counts.items()))
        return counts

    done, failed = run_all(codes, one, a.continue_on_error)
    if a.pooled and done and not a.skip_regression:
        panel = alignment.pooled({c: spark.read.parquet(f"{a.out.format(code=c)}/panel") for c in done})
        print(regression.fit_ols(panel, a.outcome, list(a.predictors), ["speech_party", "country_code"]).report())
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
