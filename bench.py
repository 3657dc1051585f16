"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and the file kernels on large images; one JSON line."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import time
import zlib

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
QUERIES = (
    "q_filter_msad", "q_filter_bytes", "q_adam7_order", "q_adam7_filter", "q_scale_depths", "q_to_rgba8", "q_color_key", "q_palettize", "q_palette_pack", "q_palette_lookup", "q_adler32", "q_crc32", "q_chunk_errors", "q_first_wins",
    "q_meta_fixed", "q_meta_text", "q_anim_errors", "q_composite", "q_crop_frames", "q_encode_decode", "q_encode_palette", "q_anim_roundtrip", "q_segments",
)


def kernels() -> dict[str, float]:
    """Seconds of the file kernels on images of the published figures' shapes, the least of three runs after a first one:
    10000x9000 pixels, compressed to about the published size; 2500x3800 RGB with noise for encoding."""
    import numpy as np

    from pixelloom.functions import codec

    rng = np.random.default_rng(1)
    times: dict[str, float] = {}

    def timed(name: str, run, runs: int = 3):
        found, least = run(), float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            run()
            least = min(least, time.perf_counter() - began)
        times[name] = round(least, 3)
        return found

    def image(color: int, depth: int, kinds: tuple[int, ...]) -> bytes:
        """Mostly zeros after filtering, one byte in 150 at random: some 10 MB of 360."""
        header = codec.Header(10000, 9000, depth, color)
        rows = np.zeros((9000, header.stride + 1), np.uint8)
        flat = rows.reshape(-1)
        flat[rng.integers(0, flat.size, flat.size // 150)] = rng.integers(0, 256, flat.size // 150, dtype=np.uint8)
        rows[:, 0] = np.array(kinds)[rng.integers(0, len(kinds), 9000)]
        return codec.assemble(codec.File(header), [("IDAT", zlib.compress(rows, 1))], codec.EncodeOptions(), False)

    for name, color, depth, kinds in (("rgba8_sub", codec.RGBA, 8, (1,)), ("rgb8", codec.RGB, 8, (1,)), ("gray16", codec.GRAY, 16, (1,)), ("rgba8_mixed", codec.RGBA, 8, (0, 1, 2, 3, 4))):
        content = image(color, depth, kinds)
        file, data = timed(f"decode_{name}", lambda content=content: codec.decode(content), 1 if "mixed" in name else 3)
        if color != codec.RGBA:
            timed(f"to_bitmap_{name}", lambda file=file, data=data: codec.to_bitmap(file.header, data, None, None))
    for kind, name in enumerate(("sub", "up", "average", "paeth"), 1):
        raw = rng.integers(0, 256, (1800, 50001), dtype=np.uint8)  # 90 MB
        raw[:, 0] = kind
        timed(f"unfilter_{name}_90mb", lambda raw=raw: codec.unfilter(raw, 4), 2)
    smooth = np.add.outer(np.arange(3800) // 9, np.arange(2500) // 7)[..., None] + np.array([0, 40, 90])
    photo = (smooth + rng.normal(0, 3, smooth.shape)).astype(np.uint8).tobytes()
    file = codec.File(codec.Header(2500, 3800, 8, codec.RGB))
    for level in (4, 6, 9):
        timed(f"encode_level_{level}_auto", lambda level=level: codec.encode(file, photo, codec.EncodeOptions(level=level, threads="auto")), 1)
    return times


def main() -> None:
    from pyspark.sql import SparkSession

    from pixelloom.plans import registry

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    queries[QUERIES[0]](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # warm
    for name in QUERIES:
        began = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    # in a process of its own, so that what Spark left behind doesn't count
    done = subprocess.run([sys.executable, os.path.abspath(__file__), "kernels"], capture_output=True, text=True, check=True)
    times |= json.loads(done.stdout.strip().splitlines()[-1])
    print(json.dumps({"metric": "total time of headline queries and of the file kernels", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    if sys.argv[1:] == ["kernels"]:
        print(json.dumps(kernels()))
    else:
        main()
