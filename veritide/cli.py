"""Command line over a Store: a table of commands, each a handler that turns options into lines and an exit code."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritide.config import EngineConfig
from veritide.functions.scoring import HashEmbedder, OverlapEntailment, OverlapReranker
from veritide.operators import retrieval, verdicts
from veritide.operators import store as ops
from veritide.plans.ingest import ingest, prune
from veritide.plans.search import search_chunks
from veritide.plans.verify import cited_works, verify
from veritide.mcp import serve
from veritide.shipping import ship
from veritide.sources.files import check_path, drafts, pdf_listing, revision_markdown, write_atomically, write_json
from veritide.sources.tables import Store

NOTE = "Suggestions only: no draft is changed."


class Application:
    """The engine's services over one store and one folder of documents. Models and the extractor can be replaced."""

    def __init__(self, spark: SparkSession, data: str, documents: str, config: EngineConfig = EngineConfig(), embedder=None, reranker=None, entailment=None, extractor=None, recogniser=None):
        self.spark, self.config, self.documents, self.data = ship(spark), config, documents, data
        self.embedder, self.reranker, self.entailment = embedder or HashEmbedder(), reranker or OverlapReranker(), entailment or OverlapEntailment()
        self.extractor, self.recogniser = extractor, recogniser
        self.store = Store(spark, f"{data}/store", self.embedder.dimension)

    def listing(self, path: str | None = None) -> DataFrame:
        return pdf_listing(self.spark, path or self.documents, self.documents)

    def ingest(self, path: str, on_progress=None) -> DataFrame:
        check_path(path)
        if self.extractor is None:
            raise RuntimeError("no PDF extractor is configured (--extractor module:function)")
        return ingest(self.store, self.listing(path), self.extractor, self.embedder, self.config, recogniser=self.recogniser, on_progress=on_progress)

    def prune(self, path: str | None = None, dry_run: bool = False) -> DataFrame:
        return prune(self.store, self.listing().select("source_path", "current_hash"), path, dry_run)

    def search(self, query: str, top_k: int | None = None, document_filter: str | dict | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("query must not be empty")
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        where = None if document_filter is None else retrieval.document_filter(document_filter)
        return search_chunks(self.store.read("chunks"), asked, self.embedder, self.reranker, self.config, top_k, where).orderBy("position")

    def reference(self, citation_id: str) -> dict | None:
        row = self.store.find([citation_id]).drop("embedding").first()
        if row is None:
            return None
        found = row.asDict(recursive=True)
        if found["source_path"] and not os.path.isabs(found["source_path"]):
            found["source_path"] = os.path.abspath(os.path.join(self.documents, found["source_path"]))
        return found

    def documents_list(self) -> DataFrame:
        return ops.listed(self.store.read("manifest"))

    def verify(self, path: str, strict: bool = False):
        live = self.listing().select("source_path", "current_hash")
        return verify(drafts(self.spark, path), self.store.read("chunks"), live, self.entailment, (self.embedder, self.reranker), strict, self.config)

    def citations(self, path: str) -> tuple[DataFrame, DataFrame]:
        return cited_works(drafts(self.spark, path), self.store.read("chunks"), self.listing().select("source_path", "current_hash"), self.config)

    def health(self) -> dict:
        exists = self.store.exists()
        counts = ops.health(self.store.read("chunks")).first()
        folder = Path(self.documents).is_dir()
        return {"status": "ok" if exists and folder else "error", "collection_exists": exists, "documents_path_exists": folder, **counts.asDict()}

    def tools(self) -> dict:
        """The read-only tools that an agent can call: name to function of JSON values."""
        score = F.col("relevance_score")
        found = lambda query, top_k=5, document_filter=None: [json.loads(r[0]) for r in self.search(query, top_k, document_filter).select(retrieval.result_json(score)).collect()]
        return {
            "search_references": found,
            "get_reference": lambda citation_id: self.reference(citation_id) or {"error": "reference not found"},
            "list_documents": lambda: [r.asDict() for r in self.documents_list().collect()],
        }

    def models(self) -> dict[str, str]:
        """Loads each model by one call: what came of it, by name."""
        calls = {
            "embedder": lambda: f"{self.embedder.embed(['warm up']).shape[1]} dimensions",
            "reranker": lambda: f"{len(self.reranker.score([('warm', 'up')]))} score",
            "entailment": lambda: f"{len(self.entailment.score([('warm', 'up')])[0])} classes",
        }
        out = {}
        for name, call in calls.items():
            try:
                out[name] = call()
            except Exception as e:  # one model that cannot load must not hide the others
                out[name] = f"failed: {e}"
        return out


@dataclass
class Outcome:
    """What a command says on both channels, and its exit code."""

    lines: list[str] = field(default_factory=list)
    code: int = 0
    warnings: list[str] = field(default_factory=list)


def _count(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def _issues(rows: list[dict]) -> list[str]:
    return [f"{issue['failure']}: {issue['message']}" for row in rows for issue in row["issues"]]


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


def _ingest(app: Application, o: argparse.Namespace) -> Outcome:
    say = lambda step, counts: sys.stderr.write(f"{step}: {', '.join(f'{v} {k}' for k, v in counts.items())}\n")
    rows = _rows(app.ingest(o.path, say).orderBy("source_path"))
    lines = [f"{r['source_path']}\t{r['status']}\t{r['error'] or r['chunk_count']}" for r in rows]
    warnings = [f"{r['source_path']}: {w}" for r in rows for w in r["warnings"]]
    by_status = {s: sum(r["status"] == s for r in rows) for s in ("new", "changed", "unchanged", "failed")}
    return Outcome([*lines, ", ".join(f"{n} {s}" for s, n in by_status.items())], int(by_status["failed"] > 0), warnings)


def _prune(app: Application, o: argparse.Namespace) -> Outcome:
    rows = _rows(app.prune(o.path, o.dry_run))
    lines = [f"{r['reason']}\t{r['source_path']}\t{r['error'] or r['chunk_count']}" for r in rows]
    return Outcome([*lines, f"{len(rows)} stale entries{' (dry run: kept)' if o.dry_run else ''}"], int(any(r["error"] for r in rows)))


def _search(app: Application, o: argparse.Namespace) -> Outcome:
    return Outcome([r[0] + "\n" for r in app.search(o.query, o.top_k, o.document_filter).select(retrieval.result_line(F.col("relevance_score"))).collect()] or ["no match"])


def _reference(app: Application, o: argparse.Namespace) -> Outcome:
    found = app.reference(o.citation_id)
    return Outcome([json.dumps(found, ensure_ascii=False, indent=2, default=str)]) if found else Outcome(code=1, warnings=[f"no chunk is cited as {o.citation_id}"])


def _verify(app: Application, o: argparse.Namespace) -> Outcome:
    report = app.verify(o.document, o.strict)
    claims, structural = _rows(report.claims.orderBy("draft_id", "claim_pos")), _rows(report.structural)
    failed = any(r["failed"] for r in report.drafts.collect())
    path = write_json(_beside(app, o.document, "report.json"), {"strict": o.strict, "failed": failed, "structural": structural, "claims": claims})
    open_claims = [f"{c['verdict']}\t{c['text']}\t{'; '.join(c['reasons'])}" for c in claims if c["claim_type"] == "LITERATURE_CLAIM" and c["verdict"] != "SUPPORTED"]
    counts = [f"{r['n']} {r['verdict']}" for r in verdicts.histogram(report.claims).collect()]
    return Outcome([*_issues(structural), *open_claims, ", ".join(counts) or "no claims", str(path)], int(failed))


def _revise(app: Application, o: argparse.Namespace) -> Outcome:
    items = _rows(app.verify(o.document).plan().orderBy("draft_id", "claim_pos"))
    paths = [
        write_json(_beside(app, o.document, "revision.json"), {"note": NOTE, "items": items}),
        write_atomically(_beside(app, o.document, "revision.md"), revision_markdown(items, NOTE)),
    ]
    return Outcome([f"{len(items)} suggestions", *map(str, paths)])


def _citations(app: Application, o: argparse.Namespace) -> Outcome:
    entries, results = app.citations(o.document)
    bad = _issues(_rows(results.where("not valid")))
    return Outcome([r["entry"] for r in entries.collect()], int(bool(bad)), bad)


def _evaluate(app: Application, o: argparse.Namespace) -> Outcome:
    _, scores = verdicts.evaluation(app.spark.read.json(o.records))
    return Outcome([f"{r['label']}\t" + "\t".join(f"{r[c]:.3f}" for c in ("precision", "recall", "f1")) for r in scores.collect()])


def _list(app: Application, o: argparse.Namespace) -> Outcome:
    return Outcome([f"{r['source_path']}\t{r['chunk_count']}\t{r['indexed_at']}" for r in app.documents_list().collect()])


def _health(app: Application, o: argparse.Namespace) -> Outcome:
    models = app.models()
    state = app.health() | {"models": models}
    return Outcome([json.dumps(state, indent=2)], int(state["status"] != "ok" or any(m.startswith("failed") for m in models.values())))


def _models(app: Application, o: argparse.Namespace) -> Outcome:
    found = app.models()
    return Outcome([f"{k}\t{v}" for k, v in found.items()], int(any(v.startswith("failed") for v in found.values())))


def _mcp(app: Application, o: argparse.Namespace) -> Outcome:
    serve(app.tools(), sys.stdin, sys.stdout)
    return Outcome()


def _beside(app: Application, document: str, kind: str) -> str:
    return f"{app.data}/verification/{Path(document).name}.{kind}"


PATH, DOCUMENT = ("path", {}), ("document", {})
#: name: handler and arguments
COMMANDS: dict[str, tuple[Callable[[Application, argparse.Namespace], Outcome], tuple]] = {
    "ingest": (_ingest, (PATH,)),
    "prune": (_prune, (("path", {"nargs": "?"}), ("--dry-run", {"action": "store_true"}))),
    "search": (_search, (("query", {}), ("--top-k", {"type": _count}), ("--document-filter", {}))),
    "reference": (_reference, (("citation_id", {}),)),
    "list": (_list, ()),
    "verify": (_verify, (DOCUMENT, ("--strict", {"action": "store_true"}))),
    "revise": (_revise, (DOCUMENT,)),
    "citations": (_citations, (DOCUMENT,)),
    "evaluate": (_evaluate, (("records", {"help": "JSON lines with expected and predicted"}),)),
    "health": (_health, ()),
    "models": (_models, (("action", {"choices": ["download"], "nargs": "?"}),)),
    "mcp": (_mcp, ()),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veritide", description="Evidence retrieval and citation checking on Spark")
    p.add_argument("-v", "--verbose", action="store_true", help="let Spark log too")
    for name, default in (("--data", "data"), ("--documents", "documents")):
        p.add_argument(name, default=default)
    p.add_argument("--extractor", help="module:function that turns a file name and bytes into pages")
    commands = p.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        own = commands.add_parser(name)
        for argument, options in arguments:
            own.add_argument(argument, **options)
    return p


def run(app: Application, args: argparse.Namespace) -> int:
    """One command, rendered; the exit code."""
    done = COMMANDS[args.command][0](app, args)
    for channel, lines in ((sys.stdout, done.lines), (sys.stderr, done.warnings)):
        channel.writelines(f"{line}\n" for line in lines)
    return done.code


def application(args: argparse.Namespace) -> Application:
    spark = SparkSession.builder.appName("veritide").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR")
    module, _, name = (args.extractor or "").partition(":")
    return Application(spark, args.data, args.documents, extractor=getattr(importlib.import_module(module), name) if module else None)


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 fine, 1 findings or failures, 2 wrong usage, 130 broken off."""
    args = parser().parse_args(argv)
    code = 130
    try:
        code = run(application(args), args)
    except (ArithmeticError, LookupError, OSError, RuntimeError, TypeError, ValueError, PySparkException) as problem:
        code = 130 if isinstance(problem, BrokenPipeError) else 1
        sys.stderr.write(f"{args.command}: {problem}\n")
    except KeyboardInterrupt:
        sys.stderr.write(f"{args.command}: broken off\n")
    return code


if __name__ == "__main__":
    raise SystemExit(main())
