"""Command line: refine transcripts, make subtitles."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    from verbatik.operators import refine, subtitles
    from verbatik.sources import segments as sg

    parser = argparse.ArgumentParser(prog="verbatik", description=__doc__)
    parser.add_argument("command", choices=("refine", "srt"))
    parser.add_argument("input", help="transcript JSON files")
    parser.add_argument("output", help="folder to write")
    parser.add_argument("--master", default=None)
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName("verbatik")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    rows = sg.explode_segments(sg.read_transcripts(spark, args.input))
    if args.command == "refine":
        sg.write_transcripts(refine.refine(rows), args.output)
    else:
        subtitles.write(subtitles.cues(rows), args.output)


if __name__ == "__main__":
    main()
