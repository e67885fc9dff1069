"""Command line: ``encode FOLDER FILE`` and ``render FILE FOLDER``."""

from __future__ import annotations

import argparse
import os
import uuid

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glyphmill")
    sub = top.add_subparsers(dest="what", required=True)
    e = sub.add_parser("encode")
    e.add_argument("folder")
    e.add_argument("file")
    e.add_argument("--mode", choices=["global", "hybrid", "frame"], default="global")
    e.add_argument("--duration", type=int, default=6, help="ticks of a sixtieth of a second a frame")
    e.add_argument("--coherence", type=int, default=0, help="glyphs reserved for patterns that frames have in common")
    e.add_argument("--denoise", type=int, default=0, help="size of islands to remove from glyphs")
    e.add_argument("--rle", action="store_true")
    e.add_argument("--high-quality", action="store_true", help="glyphs fitted in Oklab, cells by least error")
    e.add_argument("--crop", action="store_true", help="fill the canvas and crop what is over")
    e.add_argument("--split-palette", action="store_true", help="a colour table each for foregrounds and backgrounds")
    e.add_argument("--four-luts", action="store_true", help="two colour tables each; not in frame mode")
    e.add_argument("--glyphs", help="a file of 1024 x 8 bytes to use instead of clustering, in global mode")
    r = sub.add_parser("render")
    r.add_argument("file")
    r.add_argument("folder")
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    a = top.parse_args(argv)
    if a.what == "encode" and a.mode == "frame" and a.four_luts:
        top.error("--four-luts is not supported with --mode frame")
    spark = SparkSession.builder.appName("glyphmill").getOrCreate()
    if a.what == "render":
        from glyphmill.sources.container import write_pngs

        write_pngs(spark, a.file, a.folder, lambda k, n, name: print(f"{k}/{n} {name}"))
        return 0
    from glyphmill.plans.encode import Config, parts, read_glyphs

    if a.mode == "global" and a.coherence:
        print("--coherence has no effect in global mode, where all frames share their glyphs")
    if a.mode != "global" and a.glyphs:
        print("--glyphs is only for global mode and is ignored")
    config = Config(a.mode, a.duration, a.rle, a.coherence, a.denoise, a.high_quality, a.crop, a.split_palette, a.four_luts)
    part = f"{a.file}.{uuid.uuid4().hex}"
    try:
        glyphs = read_glyphs(a.glyphs) if a.glyphs and a.mode == "global" else None
        with open(part, "wb") as out:
            for data in parts(spark, a.folder, config, glyphs):
                out.write(data)
        os.replace(part, a.file)
    except ValueError as x:
        print(x)
        return 1
    finally:
        if os.path.exists(part):
            os.remove(part)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
