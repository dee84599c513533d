"""Audio columns: payloads stored as 8-bit mono WAV, and features of what is read back.

Features: polyphase resampling to half the rate, overlapped log-mel filterbanks, and energy segments with hysteresis. The filterbank
frames are stored as Arrow fixed-shape tensors of `FRAMES` x `MELS` (an Arrow IPC stream in a binary column), each
with its time span; segments are spans in seconds.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RATE, DOWN, TAPS = 16_000, 2, 32
FRAME, HOP, MELS, FRAMES = 256, 128, 16, 32
#: Energy above the quietest frame, as shares of the range, that opens and closes a segment.
OPEN, CLOSE = 0.6, 0.4
UNIT = 576
HEADER = 44
#: Samples that one pass of the filterbank takes.
_PASS = 1 << 18


def wav(payload: bytes) -> bytes:
    """A WAV file of 8-bit unsigned mono samples: a header of 44 bytes, then the payload."""
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def samples(media: bytes) -> np.ndarray:
    import io
    import wave

    with wave.open(io.BytesIO(media), "rb") as w:
        return np.frombuffer(w.readframes(w.getnframes()), np.uint8)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A low-pass kernel, a window, and the mel filterbank."""
    t = np.arange(TAPS) - (TAPS - 1) / 2
    kernel = np.sinc(t / DOWN) * np.hamming(TAPS)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(RATE / DOWN / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, DOWN / RATE)[:, None]
    up, down = (bins - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - bins) / np.diff(edges)[1:]
    return (kernel / kernel.sum()).astype(np.float32), np.hanning(FRAME).astype(np.float32), np.clip(np.minimum(up, down), 0, None).astype(np.float32)


def resampled(x: np.ndarray) -> np.ndarray:
    """Half the rate, by the polyphase form: each phase of the kernel meets its own phase of the samples."""
    kernel = _tables()[0]
    padded = np.pad(x, (TAPS // 2, TAPS // 2 + DOWN))
    n = -(-len(x) // DOWN)
    out = np.zeros(n, np.float32)
    for phase in range(DOWN):
        part, taps = padded[phase::DOWN], kernel[phase::DOWN]
        out += np.convolve(part[: n + len(taps) - 1], taps[::-1], "valid")[:n]
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, MELS) of 8-bit samples; there is one frame at least."""
    _, window, bank = _tables()
    y = resampled((x.astype(np.float32) - 128) / 128)
    y = np.pad(y, (0, max(0, FRAME - len(y))))
    y = np.pad(y, (0, -(len(y) - FRAME) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = [np.log(np.abs(np.fft.rfft(frames[i : i + _PASS // FRAME] * window, axis=1)).astype(np.float32) ** 2 @ bank + 1e-6) for i in range(0, len(frames), _PASS // FRAME)]
    return np.concatenate(out).astype(np.float32)


def segments(mel: np.ndarray) -> list[tuple[float, float]]:
    """Time spans whose energy rose above the opening level and has not yet fallen below the closing one."""
    energy = mel.mean(axis=1)
    low, high = float(energy.min()), float(energy.max())
    above, below = energy >= low + OPEN * (high - low), energy < low + CLOSE * (high - low)
    state = np.where(above, 1, np.where(below, 0, -1))
    known = np.where(state >= 0, np.arange(len(state)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, state[last], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    step = HOP * DOWN / RATE
    return [(float(a * step), float(b * step)) for a, b in zip(edge[::2], edge[1::2])]


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow IPC stream: fixed-shape tensors FRAMES x MELS (zeros behind the last frame) and their spans in seconds."""
    import pyarrow as pa

    n = -(-len(mel) // FRAMES)
    full = np.zeros((n * FRAMES, MELS), np.float32)
    full[: len(mel)] = mel
    kind, spans = _arrow()
    step = HOP * DOWN / RATE
    begin = np.arange(n) * (FRAMES * step)
    end = np.minimum(begin + FRAMES * step, len(mel) * step)
    column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * MELS))
    batch = pa.RecordBatch.from_arrays([column, pa.array(begin), pa.array(end)], schema=spans)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, spans) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


@functools.cache
def _arrow():
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    return kind, pa.schema([("log_mel", kind), ("begin_s", pa.float64()), ("end_s", pa.float64())])


def recorded(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns papyra_media (WAV bytes), papyra_tensors (Arrow IPC bytes), papyra_spans (begin, end in seconds) and papyra_mel (MELS floats);
    a name that docs has in use gets an underscore more.

    A text's UTF-8 bytes, with bytes 255 up to a positive multiple of 576, are the samples; null counts as empty. All features are made from
    the stored bytes, so equal texts have equal values. Any length is taken whole, a block of frames at a time.
    """
    place = docs.columns.index(text)
    made_names = [C.fresh(docs, f"papyra_{x}") for x in ("media", "tensors", "spans", "mel")]

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("begin", pa.float64()), ("end", pa.float64())]))
        for batch in batches:
            data, offsets = C.utf8(batch.column(place))
            for i, j in C.passes(offsets):
                made = []
                for k in range(i, j):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    media = wav(raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)))
                    mel = log_mel(samples(media))
                    made.append((media, tensors(mel), [{"begin": a, "end": b} for a, b in segments(mel)], np.round(mel.mean(axis=0, dtype=np.float64), 4).tolist()))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*made), (pa.binary(), pa.binary(), span, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns)), *columns], names=[*batch.schema.names, *made_names])

    schema = C.extended(docs.schema, "{} binary, {} binary, {} array<struct<begin:double,end:double>>, {} array<double>".format(*made_names))
    return docs.mapInArrow(C.frugal(run), schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """Digest columns of recorded(): sizes, hashes and the payload as read back from the stored bytes, and a feature string.

    Null and empty texts are one unit of bytes 255; rows of equal or null id each come back; an empty table gives an empty result.
    """
    out = recorded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    payload = F.expr(f"substring(papyra_media, {HEADER + 1}, octet_length(papyra_media) - {HEADER})")
    # the length's bytes one by one, the last first: reverse() takes binary for text and keeps bytes that look like one character together
    length = F.conv(F.hex(F.concat(*[F.expr(f"substring(papyra_media, {k}, 1)") for k in (44, 43, 42, 41)])), 16, 10)
    held = out.withColumn("payload", F.when(length == F.octet_length("papyra_media") - HEADER, payload))
    active = F.aggregate("papyra_spans", F.lit(0.0), lambda a, s: a + s["end"] - s["begin"])
    feature = F.concat_ws(":", F.sha2("papyra_tensors", 256), F.array_join(F.transform("papyra_mel", lambda x: F.format_string("%.4f", x)), ","), F.size("papyra_spans").cast("string"), F.format_string("%.3f", active))
    return held.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("papyra_media").cast("long").alias("media_bytes"),
        F.sha2("papyra_media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
