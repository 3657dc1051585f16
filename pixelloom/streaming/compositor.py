"""Frames that arrive in a stream, rendered as they come: the canvas of each file is the state.

Frames may arrive in any order and more than once. A file's frames are applied in order of k; those that come early
wait in the state, a row each, and those already applied are dropped. When the last frame is shown (num_frames says
which), all that stays is a mark that the file is done; with a `ttl` that goes too, as does all of a file without news
for so long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import codec

OUTPUT = "file_id string, k long, width long, height long, data binary"
FRAME = "canvas_width long, canvas_height long, width long, height long, x long, y long, dispose int, blend int, data binary, num_frames long"
#: The next frame, and the canvas with what its last frame leaves to settle; done: no canvas any more.
CANVAS = "upcoming long, done boolean, canvas_width long, canvas_height long, pixels binary, pending boolean, x long, y long, width long, height long, below binary"
FIELDS = [part.split()[0] for part in FRAME.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def held(canvas: codec.Canvas, upcoming: int) -> tuple:
    """A canvas as a row of CANVAS."""
    area, below = canvas.pending
    rows, columns = area
    return (
        upcoming, False, canvas.header.width, canvas.header.height, canvas.pixels.tobytes(), True,
        columns.start, rows.start, columns.stop - columns.start, rows.stop - rows.start, None if below is None else below.tobytes(),
    )


def restored(row: tuple) -> codec.Canvas:
    _, _, canvas_width, canvas_height, pixels, _, x, y, width, height, below = row
    return codec.Canvas.restored(canvas_width, canvas_height, pixels, (x, y, width, height), below)


def shown(row: tuple | None, frame: tuple, k: int) -> tuple[tuple, bytes]:
    """The state after a frame, and the full canvas it shows."""
    canvas_width, canvas_height, width, height, x, y, dispose, blend, data, last = frame
    canvas = restored(row) if row else codec.Canvas(canvas_width, canvas_height)
    pixels = canvas.render(codec.Control(0, width, height, x, y, 0, 0, dispose, blend), bytes(data))
    return ((k + 1, True, *[None] * 9) if last is not None and k + 1 >= last else held(canvas, k + 1)), pixels


class Compositor(StatefulProcessor):
    def __init__(self, ttl: int | None):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.canvas = handle.getValueState("canvas", CANVAS, self.ttl)
        self.waiting = handle.getMapState("waiting", "k long", FRAME, self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        row = tuple(self.canvas.get()) if self.canvas.exists() else None
        upcoming, done = (row[0], row[1]) if row else (0, False)
        fresh: dict[int, tuple] = {}
        for batch in rows:
            if "num_frames" not in batch:
                batch["num_frames"] = None
            for k, *frame in batch[["k", *FIELDS]].itertuples(index=False, name=None):
                if k >= upcoming and not done:
                    fresh.setdefault(int(k), tuple(None if v is None or v is pd.NA or v != v else v if isinstance(v, (bytes, bytearray)) else int(v) for v in frame))
        out: list[tuple[int, bytes, int, int]] = []
        while not done:
            if upcoming in fresh:
                frame, late = fresh.pop(upcoming), self.waiting.containsKey((upcoming,))
            elif late := self.waiting.containsKey((upcoming,)):
                frame = tuple(self.waiting.getValue((upcoming,)))
            else:
                break
            if late:
                self.waiting.removeKey((upcoming,))
            row, pixels = shown(row, frame, upcoming)
            out.append((upcoming, pixels, frame[0], frame[1]))
            upcoming, done = row[0], row[1]
        if done:
            self.waiting.clear()
        for k, frame in {} if done else fresh.items():
            if not self.waiting.containsKey((k,)):
                self.waiting.updateValue((k,), frame)
        if out:
            self.canvas.update(row)
            ks, data, widths, heights = zip(*out)
            yield pd.DataFrame({"file_id": key[0], "k": ks, "width": widths, "height": heights, "data": data})

    def close(self) -> None:
        pass


def composite_stream(frames: DataFrame, ttl: str | None = None) -> DataFrame:
    """frames has file_id (string), k, canvas_width, canvas_height, width, height, x, y, dispose, blend and data (RGBA8
    of the frame's own area), and may have num_frames, how many its file has: OUTPUT, each frame's full canvas once all
    before it have come. The state needs Spark's RocksDB store, which this sets for the session."""
    from ..plans.shipping import ship

    spark = frames.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    milliseconds = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    return frames.groupBy("file_id").transformWithStateInPandas(Compositor(milliseconds), OUTPUT, "append", "processingTime" if ttl else "none")
