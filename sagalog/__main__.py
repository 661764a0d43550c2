"""Command line: dump the text of a PDF, extract its images, clean extracted text."""

from __future__ import annotations

import argparse
import sys
import tempfile
from pathlib import Path


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sagalog")
    verbs = parser.add_subparsers(dest="verb", required=True)
    dump = verbs.add_parser("dump", help="text of a PDF, pages parted by form feeds")
    images = verbs.add_parser("images", help="images of a PDF and their manifest")
    clean = verbs.add_parser("clean", help="markdown from extracted text")
    for p in (dump, images):
        p.add_argument("path")
        p.add_argument("--page", type=int, default=0)
        p.add_argument("--pages", default="")
    images.add_argument("--out", required=True)
    images.add_argument("--no-stitch", action="store_true")
    images.add_argument("--tol", type=float, default=2.0)
    clean.add_argument("path")
    clean.add_argument("--manifest", default="")
    clean.add_argument("--imgdir", default="")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .model import EngineError
    from .plans.tools import FILE_BREAK, Engine
    from .sources.store import MessageStore

    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    engine = Engine(spark, MessageStore(spark, tempfile.mkdtemp(prefix="sagalog-")))
    try:
        if args.verb == "dump":
            sys.stdout.write(engine.pdf_extract_text(args.path, args.page, args.pages, FILE_BREAK)["text"] + "\n")
        elif args.verb == "images":
            rows = engine.pdf_extract_images(args.path, args.out, args.page, args.pages, not args.no_stitch, args.tol)
            sys.stdout.write(f"{len(rows)} images\n")
        else:
            sys.stdout.write(engine.pdf_clean_text(Path(args.path).read_text(encoding="utf-8"), args.manifest, args.imgdir)["markdown"])
    except EngineError as e:
        sys.stderr.write(f"{e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
