"""Files that arrive in chunks, decoded as they come: the state of each image is kept from one micro-batch to the next.

A chunk (image, n, data) is any stretch of a file's bytes. An image's state has the bytes that can't be used yet, the headers
read so far, and inside a scan the place in the current segment: bits, DC values, blocks known to have ended. Every batch
takes an image as far as its bytes go and gives the blocks that are whole; so blocks come out in the order of coding while
the file is incomplete, and how the bytes were cut makes no difference to them. Chunks that overtake others wait.

First passes of Huffman coded scans are decoded (sequential files are whole then); refinements need an image's blocks and
are left to `operators.decoding`. Segments follow their markers' numbers as there. A lost segment, and what follows a break
in one, gives zeros that are not valid; what was given out before the break stays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.functions.tables import shared_dir
from lumenframe.operators import decoding as DE
from lumenframe.operators import scans as S
from lumenframe.operators.blocks import zigzag

BLOCKS = "image bigint, scan bigint, comp bigint, `by` bigint, bx bigint, q array<bigint>, valid boolean"


class Short(Exception):
    """There are not enough bits yet."""


class OpenBits(S.Bits):
    """Bits of a segment that may go on: what is not there yet can be looked at (as ones), not used."""

    def __init__(self, data: bytes, at: int, whole: bool):
        self.data, self.at, self.end = data + b"\xff" * 8, at, 8 * len(data) + (64 if whole else 0)

    def get(self, n: int) -> int:
        first = self.at >> 3
        v = int.from_bytes(self.data[first : first + 5].ljust(5, b"\xff"), "big") >> (40 - (self.at & 7) - n) & ((1 << n) - 1)
        self.at += n
        return v

    def check(self) -> None:
        if self.at > self.end:
            raise Short


class OpenFile:
    """A file as far as it has come."""

    def __init__(self):
        self.raw, self.place, self.waiting = b"", 0, {}
        self.frame: S.Geometry | None = None
        self.ids: list[int] = []
        self.codes: dict[tuple[int, int], tuple] = {}
        self.interval, self.scan, self.scans, self.progressive = 0, None, 0, False

    def add(self, n: int, data: bytes) -> Iterator[tuple]:
        """Rows (scan, comp, by, bx, q in zig-zag order, valid) that a chunk makes possible."""
        self.waiting[n] = data
        while self.place in self.waiting:
            self.raw += self.waiting.pop(self.place)
            self.place += 1
        while True:
            if self.scan is None:
                if not self._header():
                    return
            else:
                done = yield from self._data()
                if not done:
                    return

    def _header(self) -> bool:
        """Take one marker segment off; False: it isn't whole yet, or the file is at its end."""
        raw = self.raw
        if len(raw) < 2 or raw[0] != 0xFF or raw[1] == 0xD9:
            return False
        if raw[1] == 0xD8:
            self.raw = raw[2:]
            return True
        if len(raw) < 4 or len(raw) < 2 + int.from_bytes(raw[2:4], "big"):
            return False
        n = int.from_bytes(raw[2:4], "big")
        code, p = raw[1], raw[4 : 2 + n]
        self.raw = raw[2 + n :]
        if code in (0xC0, 0xC1, 0xC2):
            parts = [p[6 + 3 * k : 9 + 3 * k] for k in range(p[5])]
            self.ids, self.progressive = [x[0] for x in parts], code == 0xC2
            self.frame = S.Geometry(int.from_bytes(p[3:5], "big"), int.from_bytes(p[1:3], "big"), [(x[1] >> 4, x[1] & 15) for x in parts])
        elif code == 0xC4:
            while p:
                counts, total = list(p[1:17]), sum(p[1:17])
                self.codes[p[0] >> 4, p[0] & 15] = tuple(k for k, c in enumerate(counts, 1) for _ in range(c)), tuple(p[17 : 17 + total])
                p = p[17 + total :]
        elif code == 0xDD:
            self.interval = int.from_bytes(p[:2], "big")
        elif code == 0xDA and self.frame is not None:
            of = [(self.ids.index(p[1 + 2 * k]), p[2 + 2 * k]) for k in range(p[0])]
            ss, se, bits = p[1 + 2 * p[0] : 4 + 2 * p[0]]
            comps, tables = [c for c, _ in of], {}
            for c, t in of:
                for tc, th in ((0, t >> 4), (1, t & 15)):
                    if (tc, th) in self.codes:
                        tables[tc, c] = self.codes[tc, th]
            mcus = DE.len_order(self.frame, comps)
            step = self.interval or max(mcus, 1)
            self.scan = {"comps": comps, "tables": tables, "ss": ss, "se": se, "ah": bits >> 4, "al": bits & 15, "step": step, "segments": -(-mcus // step), "wanted": 1}
            self._segment(0)
            self.scans += 1
        return True

    def _segment(self, seg: int | None) -> None:
        """Start a segment (None: its data are dropped)."""
        s = self.scan
        s |= {"seg": seg, "at": 0, "data": b"", "before": {}, "ended": 0, "mcu": 0}

    def _zeros(self, seg: int, first: int) -> Iterator[tuple]:
        """The blocks of a segment from its MCU `first` on, as lost."""
        s = self.scan
        for c, y, x in DE.segment_blocks(self.frame, s["comps"], seg * s["step"] + first, s["step"] - first):
            yield self.scans - 1, c, y, x, [0] * 64, False

    def _mcus(self, whole: bool) -> Iterator[tuple]:
        """Blocks of the segment as far as its bits go."""
        s = self.scan
        if s["ah"] or s["seg"] is None:
            s["data"] = b""
            return
        tables = {k: S.lookup(*v) for k, v in s["tables"].items()}
        total = min(s["step"], DE.len_order(self.frame, s["comps"]) - s["seg"] * s["step"])
        bits = OpenBits(s["data"], s["at"], whole)
        while s["mcu"] < total:
            keys = DE.segment_blocks(self.frame, s["comps"], s["seg"] * s["step"] + s["mcu"], 1)
            rows, state = [(k[0], [0] * 64) for k in keys], S.Running(s["before"], s["ended"])
            try:
                S.read_first(bits, rows, tables, s["ss"], s["se"], s["al"], state, self.progressive)
                bits.check()
            except (Short, ValueError, IndexError, KeyError):
                if not whole:  # a wrong code may be a right one that isn't all there
                    bits.at = s["at"]
                    break
                yield from self._zeros(s["seg"], s["mcu"])
                s["mcu"] = total
                break
            for (c, y, x), (_, q) in zip(keys, rows, strict=True):
                yield self.scans - 1, c, y, x, q, True
            s["before"], s["ended"] = dict(state.before), state.ended
            s["at"], s["mcu"] = bits.at, s["mcu"] + 1
        used = s["at"] >> 3
        s["data"], s["at"] = s["data"][used:], s["at"] & 7

    def _data(self) -> Iterator[tuple]:
        """Entropy coded data up to the next marker, if it is there. Returns whether to go on."""
        s, raw = self.scan, self.raw
        end = 0
        while True:
            end = raw.find(b"\xff", end)
            if end < 0 or end + 1 >= len(raw) or raw[end + 1] != 0:
                break
            end += 2
        whole = 0 <= end < len(raw) - 1
        upto = end if end >= 0 else len(raw)
        s["data"] += raw[:upto].replace(b"\xff\x00", b"\xff")
        self.raw = raw[upto:]
        yield from self._mcus(whole)
        if not whole:
            return False
        number = self.raw[1] - 0xD0
        if 0 <= number < 8:
            self.raw = self.raw[2:]
            ahead = (number - (s["wanted"] - 1)) % 8
            if ahead < DE.AHEAD and s["wanted"] + ahead < s["segments"]:
                yield from self._lost(s["wanted"], s["wanted"] + ahead)
                s["wanted"] += ahead + 1
                self._segment(s["wanted"] - 1)
            else:
                self._segment(None)
            return True
        yield from self._lost(s["wanted"], s["segments"])
        self.scan = None
        return True

    def _lost(self, first: int, end: int) -> Iterator[tuple]:
        if not self.scan["ah"]:
            for seg in range(first, end):
                yield from self._zeros(seg, 0)


def _advanced(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    file = pickle.loads(state.get[0]) if state.exists else OpenFile()
    rows: list[tuple] = []
    for p in parts:
        for n, data in sorted(zip(p.n.tolist(), p.data.tolist(), strict=True)):
            rows += file.add(n, data)
    state.update((pickle.dumps(file),))
    back = np.argsort(zigzag())
    if rows:
        scan, comp, by, bx, q, valid = zip(*rows, strict=True)
        yield pd.DataFrame({"image": key[0], "scan": scan, "comp": comp, "by": by, "bx": bx, "q": list(np.array(q, np.int64)[:, back]), "valid": valid})


def decoded(chunks: DataFrame) -> DataFrame:
    """BLOCKS as a stream from a stream of chunks (image, n: from 0, data). scan counts an image's scans."""
    return chunks.groupBy("image").applyInPandasWithState(_advanced, BLOCKS, "file binary", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, source: str, files: int = 1) -> DataFrame:
    """Decode the chunk files (Parquet) in a folder, so many files a batch, and return the blocks given out. State and blocks lie in the shared folder."""
    at = shared_dir(spark)
    chunks = spark.readStream.schema("image bigint, n bigint, data binary").option("maxFilesPerTrigger", files).parquet(source)
    q = (
        decoded(chunks).writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
        .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{at}/blocks/batch={k}")).start()
    )
    q.awaitTermination()
    return spark.read.parquet(f"{at}/blocks").drop("batch")
