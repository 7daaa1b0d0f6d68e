"""Command-line options of the jobs, as the dataclasses that the jobs take."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from tidewater.plans.ingest import Limits
from tidewater.plans.jobs import Download, Reprocess
from tidewater.sources.fetch import Throttle


def ingest_options(arguments: Sequence[str] | None = None) -> Limits:
    parser = argparse.ArgumentParser(prog="ingest")
    parser.add_argument("--documents-dir", default=Limits.documents_dir)
    parser.add_argument("--no-download-documents", action="store_true")
    parser.add_argument("--max-insurers", type=int)
    parser.add_argument("--max-pages-per-insurer", type=int, default=Limits.max_pages)
    parser.add_argument("--max-depth", type=int, default=Limits.max_depth)
    given = parser.parse_args(arguments)
    return Limits(given.max_pages_per_insurer, given.max_depth, given.max_insurers, given.documents_dir, download=not given.no_download_documents)


def reprocess_options(arguments: Sequence[str] | None = None) -> Reprocess:
    parser = argparse.ArgumentParser(prog="reprocess")
    parser.add_argument("--insurer", action="append", default=[])
    parser.add_argument("--max-documents", type=int)
    parser.add_argument("--only-missing-text", action="store_true")
    parser.add_argument("--skip-policy-sections", action="store_true")
    given = parser.parse_args(arguments)
    return Reprocess(tuple(given.insurer), only_missing_text=given.only_missing_text, limit=given.max_documents, with_sections=not given.skip_policy_sections)


def download_options(arguments: Sequence[str] | None = None) -> Download:
    parser = argparse.ArgumentParser(prog="download")
    parser.add_argument("--documents-dir", default=Download.folder)
    parser.add_argument("--queue", default=Download.queue)
    parser.add_argument("--min-delay", type=float, default=Throttle.least)
    parser.add_argument("--max-delay", type=float, default=Throttle.most)
    parser.add_argument("--max-parallel-insurers", type=int, default=Throttle.parallel)
    parser.add_argument("--retries", type=int, default=Download.retries)
    parser.add_argument("--request-timeout", type=float, default=Download.timeout)
    given = parser.parse_args(arguments)
    return Download(given.documents_dir, given.queue, Throttle(max(1, given.max_parallel_insurers), given.min_delay, given.max_delay), max(0, given.retries), given.request_timeout)
