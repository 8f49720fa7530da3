"""Telephone audio in media columns: mu-law, A-law and ADPCM clips decoded and resampled to one rate.

A media column holds WAVE files. `decode` reads each one, expands G.711 codes by a table of 256 numbers or decodes IMA
ADPCM, whose blocks stand alone: one numpy step decodes the next nibble of all blocks of all clips at hand. Channels are
averaged, and a polyphase filter with whole-number taps brings the clip to the target rate, stored as 16-bit PCM. Whole numbers make a clip's result
the same whatever clips it is decoded with. `store` goes the other way for arbitrary bytes: they become the codes of a clip,
unchanged, in one of the three formats.

Defined results: a null medium gives nulls; one that isn't a readable WAVE file of these formats gives the reason in `error` and
nulls in the rest; a data chunk cut short is read as far as it goes; codes after the last whole frame or block count in `payload` but not
in the sound; a clip without samples is empty PCM; null and empty texts are stored as 64 zero bytes; repeated rows have equal results; an empty table gives an empty result; other columns pass through, and
new ones get underscores where their names are taken.
"""

from __future__ import annotations

import struct
import zlib
from math import gcd

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import chunks_by_bytes, free_name

RATE = 8000
TARGET_RATE = 16_000
#: Bytes of an ADPCM block, and the unit that stored bytes are filled up to.
UNIT = 64
#: Taps of a phase to either side of a sample, bits of a tap, outputs filtered at a time.
REACH, TAP_BITS, OUTPUTS = 16, 14, 1 << 16

# Format tags of WAVE files, and step sizes and index changes of IMA ADPCM.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279,
    307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
    4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)

CODECS = {"mulaw": MULAW, "alaw": ALAW, "ima": IMA}
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", IMA: "ima"}


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(part, size + 256 << np.maximum(part - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _ima() -> tuple[np.ndarray, np.ndarray]:
    """By step index and nibble: the change of the sample, and the next index."""
    step, nibble = np.array(STEPS)[:, None], np.arange(16)
    change = (step >> 3) + (nibble & 1) * (step >> 2) + (nibble >> 1 & 1) * (step >> 1) + (nibble >> 2 & 1) * step
    index = np.arange(len(STEPS))[:, None] + np.array(CHANGES)[nibble & 7]
    return np.where(nibble & 8, -change, change).astype(np.int32).ravel(), (np.clip(index, 0, len(STEPS) - 1) * 16).astype(np.int32).ravel()


EXPAND = {MULAW: _mulaw(), ALAW: _alaw()}
CHANGE, NEXT = _ima()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks, 1 + 2 * (bytes - 4)) of mono blocks (blocks, bytes): a first sample and a step index, then nibbles, low ones first."""
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    sample = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    row = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    out[0] = sample
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(2 * (size - 4)):
        cell = row + (columns[i >> 1] >> 4 * (i & 1) & 15)
        sample = np.clip(sample + CHANGE[cell], -32768, 32767)
        row = NEXT[cell]
        out[i + 1] = sample
    return out.T


def wave(tag: int, data: bytes, rate: int = RATE, channels: int = 1, block: int = UNIT) -> bytes:
    """A WAVE file around codes; block: bytes of an ADPCM block with all channels."""
    if tag == IMA:
        per_block = 1 + 2 * (block - 4 * channels) // channels
        form = struct.pack("<HHIIHHHH", tag, channels, rate, rate * block // per_block, block, 4, 2, per_block)
    else:
        width = 2 if tag == PCM else 1
        form = struct.pack("<HHIIHH", tag, channels, rate, rate * channels * width, channels * width, 8 * width) + (b"" if tag == PCM else b"\0\0")
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data) & 0xFFFFFFFF) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 4 & 0xFFFFFFFF) + b"WAVE" + body


def parse(blob: bytes) -> tuple[int, int, int, int, int, bytes]:
    """(tag, channels, rate, block, bits, data) of a WAVE file; ValueError says what is wrong with it."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    form, at = None, 12
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], int.from_bytes(blob[at + 4 : at + 8], "little")
        if name == b"fmt ":
            if size < 16 or at + 24 > len(blob):
                raise ValueError("format chunk too short")
            form = struct.unpack_from("<HHIIHH", blob, at + 8)
        elif name == b"data":
            if not form:
                raise ValueError("data before the format")
            tag, channels, rate, _, block, bits = form
            if not channels or not rate:
                raise ValueError("no channels or no rate")
            if (tag, bits) not in ((PCM, 8), (PCM, 16), (ALAW, 8), (MULAW, 8), (IMA, 4)):
                raise ValueError(f"format {tag} with {bits} bits")
            if tag == IMA and (block <= 4 * channels or block % (4 * channels)):
                raise ValueError(f"blocks of {block} bytes")
            return tag, channels, rate, block, bits, blob[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def samples(clips: list[tuple]) -> list[np.ndarray]:
    """Mono 16-bit samples of parsed clips; ADPCM blocks of one size go together whatever clip they are from."""
    out: list = [None] * len(clips)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (tag, channels, _, block, bits, data) in enumerate(clips):
        if tag == IMA:
            shapes.setdefault((channels, block), []).append(i)
            continue
        raw = np.frombuffer(data, np.uint8)
        if tag == PCM and bits == 16:
            x = raw[: len(raw) // 2 * 2].view("<i2")
        elif tag == PCM:
            x = (raw.astype(np.int16) - 128) * 256
        else:
            x = EXPAND[tag][raw]
        out[i] = _mono(x[: len(x) // channels * channels].reshape(-1, channels))
    for (channels, block), own in shapes.items():
        whole = [len(clips[i][5]) // block for i in own]
        raw = np.concatenate([np.frombuffer(clips[i][5], np.uint8)[: n * block] for i, n in zip(own, whole, strict=True)]).reshape(-1, block // (4 * channels), channels, 4)
        sound = decode_ima(raw.transpose(0, 2, 1, 3).reshape(-1, block // channels))
        sound = sound.reshape(len(raw), channels, sound.shape[1]).transpose(0, 2, 1)
        for i, x in zip(own, np.split(sound, np.cumsum(whole)[:-1]), strict=True):
            out[i] = _mono(x.reshape(-1, channels))
    return out


def _mono(x: np.ndarray) -> np.ndarray:
    """The mean of the channels, rounded down."""
    return x[:, 0].astype(np.int16) if x.shape[1] == 1 else (x.sum(axis=1, dtype=np.int64) // x.shape[1]).astype(np.int16)


def taps(up: int, down: int) -> np.ndarray:
    """Whole-number taps (phases, taps) of a windowed sinc; each phase adds up to 2^TAP_BITS."""
    wide = max(1.0, down / up)
    reach = int(np.ceil(REACH * wide))
    at = np.arange(-reach + 1, reach + 1) - np.arange(up)[:, None] / up
    h = np.sinc(at / wide) * np.cos(np.pi / 2 * np.clip(at / reach, -1, 1)) ** 2
    h = np.rint(h / h.sum(axis=1, keepdims=True) * (1 << TAP_BITS)).astype(np.int64)
    h[:, reach - 1] += (1 << TAP_BITS) - h.sum(axis=1)
    return h


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """16-bit samples at the target rate: output j stands at input j * rate / target."""
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    if up == down or not len(x):
        return x.astype(np.int16)
    h = taps(up, down)
    reach = h.shape[1] // 2
    padded = np.pad(x, (reach - 1, reach))
    out = np.empty(-(-len(x) * up // down), np.int16)
    for phase in range(min(up, len(out))):
        first, own = phase * down // up, h[phase * down % up]
        n = len(range(phase, len(out), up))
        if np.count_nonzero(own) == 1:  # the phase falls on samples
            out[phase::up] = padded[first + reach - 1 :: down][:n]
            continue
        tap = own.astype(np.float64)  # products and sums stay below 2^53, hence exact
        for lo in range(0, n, OUTPUTS):
            m = min(OUTPUTS, n - lo)
            begin = first + lo * down
            part = padded[begin : begin + (m - 1) * down + 2 * reach].astype(np.float64)
            y = sliding_window_view(part, 2 * reach)[::down] @ tap
            out[phase + lo * up : phase + (lo + m - 1) * up + 1 : up] = np.clip(np.floor(y / (1 << TAP_BITS) + 0.5), -32768, 32767)
    return out


def feature(codec: str, sound: np.ndarray) -> str:
    """Format, samples, peak, energy, sign changes and checksum of resampled sound."""
    wide = sound.astype(np.int64)
    crossings = int((np.diff(np.signbit(wide)) != 0).sum()) if len(wide) else 0
    return f"{codec}:{len(sound)}:{int(np.abs(wide).max(initial=0))}:{int((wide * wide).sum())}:{crossings}:{zlib.crc32(sound.astype('<i2').tobytes())}"


def store(docs: DataFrame, text_col: str = "text", codec: str | None = None) -> DataFrame:
    """docs with `media`: the text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, as the codes of a clip.

    The format is the codec named, or else goes by the checksum of the bytes.
    """
    tags = [CODECS[codec]] if codec else list(CODECS.values())
    names = [*docs.columns, free_name("media", docs.columns)]

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
            for lo, hi in chunks_by_bytes(texts):
                clips = []
                for text in texts[lo:hi]:
                    data = text or b""
                    data += bytes(-len(data) % UNIT if data else UNIT)
                    clips.append(wave(tags[zlib.crc32(data) % len(tags)], data))
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], pa.array(clips, pa.binary())], names=names)

    text = F.col(f"`{text_col}`").cast("string").alias(free_name("text", docs.columns))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[-1], T.BinaryType())])
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), text).mapInArrow(run, schema)


#: What decode can return of a medium.
OUTPUTS_OF = {"codec": "string", "rate": "int", "samples": "long", "payload": "binary", "pcm": "binary", "feature": "string", "error": "string"}


def decode(media: DataFrame, media_col: str = "media", rate: int = TARGET_RATE, outputs: tuple[str, ...] = tuple(OUTPUTS_OF)) -> DataFrame:
    """media with the outputs asked for: the medium's format and rate, its codes as they are, its sound as a 16-bit mono WAVE file at the target rate,
    the sound's length and features, and what is wrong with it."""
    before = len(media.columns)
    names = [*media.columns, *(free_name(c, media.columns) for c in outputs)]
    added = T.StructType([T.StructField(n, T._parse_datatype_string(OUTPUTS_OF[c])) for n, c in zip(names[before:], outputs, strict=True)])
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[OUTPUTS_OF[c]] for c in outputs]

    def rows(blobs: list) -> list[dict]:
        found: list[dict] = [{} for _ in blobs]
        clips, own = [], []
        for row, blob in zip(found, blobs, strict=True):
            if blob is not None:
                try:
                    clips.append(parse(blob))
                    own.append(row)
                except ValueError as e:
                    row["error"] = str(e)
        for row, clip, x in zip(own, clips, samples(clips), strict=True):
            sound = resample(x, clip[2], rate)
            row |= {"codec": NAMES[clip[0]], "rate": clip[2], "samples": len(sound), "payload": clip[5]}
            if "pcm" in outputs:
                row["pcm"] = wave(PCM, sound.astype("<i2").tobytes(), rate)
            if "feature" in outputs:
                row["feature"] = feature(row["codec"], sound)
        return found

    def run(batches):
        for b in batches:
            blobs = b.column(before).to_pylist()
            for lo, hi in chunks_by_bytes(blobs, 1 << 20):
                found = rows(blobs[lo:hi])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], *(pa.array([r.get(c) for r in found], k) for c, k in zip(outputs, kinds, strict=True))], names=names)

    blob = F.col(f"`{media_col}`").cast("binary").alias(free_name("blob", media.columns))
    return media.select(*(F.col(f"`{c}`") for c in media.columns), blob).mapInArrow(run, T.StructType([*media.schema.fields, *added.fields]))


def digest(docs: DataFrame) -> DataFrame:
    """A row a document: its bytes stored as a clip, read back from it, and hashed; features of the clip's sound."""
    sized = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    stored = store(sized).drop("text")
    out = decode(stored, outputs=("payload", "feature"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
