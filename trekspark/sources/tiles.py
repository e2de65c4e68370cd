"""Elevation tiles: squares of big-endian 16-bit heights, row 0 in the north, one file a tile."""

from __future__ import annotations

import math
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

VOID = -32768
ROWS = "tile string, row_i int, col_i int, z int"
BATCH_CELLS = 1 << 18


def decode(name: str, data: bytes) -> Iterator[pa.RecordBatch]:
    """Cells of a tile row by row; voids are null. A file that is no square raises ValueError."""
    side = math.isqrt(len(data) // 2)
    if 2 * side * side != len(data):
        raise ValueError(f"{name}: {len(data)} bytes are no square of 16-bit heights")
    z = np.frombuffer(data, ">i2").astype(np.int32)
    for a in range(0, len(z), BATCH_CELLS):
        part = z[a : a + BATCH_CELLS]
        at = np.arange(a, a + len(part))
        columns = [pa.array([name] * len(part)), pa.array(at // side, pa.int32()), pa.array(at % side, pa.int32()), pa.array(part, pa.int32(), mask=part <= VOID)]
        yield pa.RecordBatch.from_arrays(columns, names=["tile", "row_i", "col_i", "z"])


def read_dem(spark: SparkSession, path: str, pattern: str = "*.hgt") -> DataFrame:
    """(tile, row_i, col_i, z) of all tiles under ``path``, which may be in any store that Spark reads; tile is the file's name
    without its ending, voids are null. A task decodes one file at a time and sends its cells on in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = posixpath.basename(batch.column(0)[k].as_py()).rsplit(".", 1)[0]
                yield from decode(name, batch.column(1)[k].as_py())

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, ROWS)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class TileWriter(DataSourceArrowWriter):
    """Writes the tiles of each task, whose rows come tile by tile, to a folder of its own; the driver moves them in place."""

    def __init__(self, path: str, side: int) -> None:
        self.path, self.side, self.folder = path, side, f"{path}/_temporary-{uuid.uuid4().hex}"

    def _open(self, where: str) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(where)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        attempt = f"{self.folder}/{uuid.uuid4().hex}"
        system, folder = self._open(attempt)
        system.create_dir(folder, recursive=True)
        names, tile, cells = [], None, None

        def close() -> None:
            if tile is not None:
                with system.open_output_stream(f"{folder}/{tile}.hgt") as out:
                    out.write(cells.tobytes())
                names.append(f"{attempt}/{tile}.hgt")

        for batch in batches:
            of, row, col, z = (batch.column(batch.schema.get_field_index(c)) for c in ("tile", "row_i", "col_i", "z"))
            codes = of.dictionary_encode()
            starts = np.append(0, np.flatnonzero(np.diff(codes.indices.to_numpy())) + 1)
            heights = z.cast(pa.float64()).fill_null(VOID).to_numpy()
            at = row.to_numpy() * self.side + col.to_numpy()
            for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
                name = of[int(a)].as_py()
                if name != tile:
                    close()
                    tile, cells = name, np.full(self.side * self.side, VOID, ">i2")
                cells[at[a:b]] = np.round(heights[a:b]).clip(VOID, 32767)
        close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, root = self._open(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.move(self._open(name)[1], f"{root}/{posixpath.basename(name)}")
        self._drop()

    def abort(self, messages: list) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        system, folder = self._open(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class TileSource(DataSource):
    """Spark format "dem_tiles": a sink for cells (tile, row_i, col_i, z) that are sorted by tile within their tasks."""

    @classmethod
    def name(cls) -> str:
        return "dem_tiles"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: object, overwrite: bool) -> TileWriter:
        return TileWriter(self.options["path"], int(self.options["side"]))


def write_dem(cells: DataFrame, path: str, side: int) -> None:
    """One file of ``side`` by ``side`` heights per tile; cells that are missing or null are void, heights are rounded to whole metres.

    A tile's cells go to one task and are streamed in order; it holds one tile. Files appear at the end, whatever tasks were
    tried twice. ``path`` is a file:, hdfs: or s3: address."""
    cells.sparkSession.dataSource.register(TileSource)
    rows = cells.select(F.col("tile").cast("string").alias("tile"), F.col("row_i").cast("int").alias("row_i"), F.col("col_i").cast("int").alias("col_i"), F.col("z").cast("double").alias("z"))
    inside = rows.where(f"tile IS NOT NULL AND row_i BETWEEN 0 AND {side - 1} AND col_i BETWEEN 0 AND {side - 1}")
    inside.repartition("tile").sortWithinPartitions("tile", "row_i", "col_i").write.format("dem_tiles").option("path", path).option("side", side).mode("append").save()
