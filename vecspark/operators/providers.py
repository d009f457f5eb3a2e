"""Inference providers: embedders, detectors and text recognition as Arrow-batched operators.

A provider is made by a factory on the executor, once per Python worker, so models are read
once and never pickled. Any object with the methods below serves; OnnxModel wraps a
model file when onnxruntime is there, and HashEmbedder is a deterministic stand-in.
"""

from __future__ import annotations

import hashlib
import shutil
import zipfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from enum import Enum
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vecspark import kernels
from vecspark.functions import image as I
from vecspark.functions.text import KNOWN_LENGTH, KNOWN_WORDS, ClipBpe, MiniLmConfig, WordPiece
from vecspark.schema import InferenceFailed, InvalidInput, InvalidModelFile, InvalidModelType, InvalidTextEmbedderResourceFiles, ModelDownloadFailed, ModelNotDownloaded, ModelNotInitialised


class Model(ABC):
    """load, run, close; run takes and gives named arrays."""

    @abstractmethod
    def load(self) -> None: ...

    @abstractmethod
    def run(self, inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]: ...

    def close(self) -> None:
        """Frees what load() took."""


class OnnxModel(Model):
    """A model file run by onnxruntime."""

    def __init__(self, path: str):
        self.path, self.session = path, None

    def load(self) -> None:
        try:
            import onnxruntime
        except ImportError as e:
            raise InvalidModelFile("onnxruntime is not installed") from e
        try:
            self.session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        except Exception as e:
            raise InvalidModelFile(str(e)) from e

    def run(self, inputs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if self.session is None:
            raise ModelNotInitialised(self.path)
        names = [o.name for o in self.session.get_outputs()]
        try:
            return dict(zip(names, self.session.run(names, inputs), strict=True))
        except Exception as e:
            raise InferenceFailed(str(e)) from e

    def close(self) -> None:
        self.session = None


class EmbeddingProvider(ABC):
    """Vectors of one dimension from items of one kind."""

    dim: int

    def __init__(self, model: Model | None = None):
        self.model, self.ready = model, False

    def initialize(self) -> None:
        if self.model is not None:
            self.model.load()
        self.ready = True

    def close(self) -> None:
        if self.model is not None:
            self.model.close()
        self.ready = False

    def embed(self, item: Any) -> np.ndarray:
        if not self.ready:
            raise ModelNotInitialised(type(self).__name__)
        return np.asarray(self._embed(item), np.float32)

    @abstractmethod
    def _embed(self, item: Any) -> np.ndarray: ...

    def _unit(self, inputs: dict[str, np.ndarray]) -> np.ndarray:
        out = next(iter(self.model.run(inputs).values()))
        return kernels.normalize(np.asarray(out, np.float32).reshape(-1)[: self.dim])


class HashEmbedder(EmbeddingProvider):
    """Unit vectors from hashed words; needs no model."""

    def __init__(self, dim: int = 64):
        super().__init__()
        self.dim = dim
        self._places: dict[str, int] = {}  # word -> its place, after dim the places that count down

    def _place(self, word: str) -> int:
        h = hashlib.md5(word.encode()).digest()
        at = int.from_bytes(h[:4], "little") % self.dim + (0 if h[4] & 1 else self.dim)
        if len(word) <= KNOWN_LENGTH:
            if len(self._places) >= KNOWN_WORDS:
                self._places.clear()
            self._places[word] = at
        return at

    def _embed(self, item: Any) -> np.ndarray:
        known = self._places
        at = [known[w] if w in known else self._place(w) for w in (item or "").lower().split()]
        n = np.bincount(np.array(at, np.int64), minlength=2 * self.dim)
        v = (n[: self.dim] - n[self.dim :]).astype(np.float32)
        if not v.any():
            v[0] = 1
        return kernels.normalize(v)


class ClipText(EmbeddingProvider):
    dim = 512

    def __init__(self, model: Model, tokenizer: ClipBpe):
        super().__init__(model)
        self.tokenizer = tokenizer

    def _embed(self, item: str) -> np.ndarray:
        clean = "".join(c for c in item if c.isascii() and (c.isalnum() or c == " ")).lower()
        ids = [49406, *self.tokenizer.ids(clean), 49407][:77]
        return self._unit({"input_ids": np.array([ids + [0] * (77 - len(ids))], np.int32)})


class MiniLmText(EmbeddingProvider):
    dim = 384

    def __init__(self, model: Model, vocab: dict[str, int], config: MiniLmConfig | None = None, length: int = 128):
        super().__init__(model)
        self.config, self.length = config or MiniLmConfig(), length
        if not {self.config.unk, self.config.cls, self.config.sep} <= set(vocab):
            raise InvalidTextEmbedderResourceFiles("the vocabulary lacks special tokens")
        self.vocab, self.pieces = vocab, WordPiece(vocab, self.config)

    def _embed(self, item: str) -> np.ndarray:
        import re

        t = item.lower() if self.config.lower else item
        t = re.sub(r"\s+", " ", re.sub(r"""([.,!?;:()"'])""", r" \1 ", t).strip())
        ids = [self.vocab[self.config.cls], *self.pieces.ids(t), self.vocab[self.config.sep]][: self.length]
        fill = [0] * (self.length - len(ids))
        return self._unit({"input_ids": np.array([ids + fill], np.int64), "attention_mask": np.array([[1] * len(ids) + fill], np.int64)})


class ImageEmbedder(EmbeddingProvider):
    """Images through a pixel function: clip_pixels (512), dino_pixels (384) or inception_pixels (512)."""

    def __init__(self, model: Model, pixels: Callable[[np.ndarray], np.ndarray], dim: int, name: str = "pixel_values"):
        super().__init__(model)
        self.pixels, self.dim, self.name = pixels, dim, name

    def _embed(self, item: np.ndarray) -> np.ndarray:
        return self._unit({self.name: self.pixels(item)[None]})


def clip_image(model: Model) -> ImageEmbedder:
    return ImageEmbedder(model, I.clip_pixels, 512)


def dino_image(model: Model) -> ImageEmbedder:
    return ImageEmbedder(model, I.dino_pixels, 384)


def inception_face(model: Model) -> ImageEmbedder:
    return ImageEmbedder(model, I.inception_pixels, 512)


class FaceDetector:
    """Boxes in the image's pixels and scores: above a score, then without strong overlaps."""

    def __init__(self, model: Model, least: float = 0.5, overlap: float = 0.3):
        self.model, self.least, self.overlap, self.ready = model, least, overlap, False

    def initialize(self) -> None:
        self.model.load()
        self.ready = True

    def detect(self, img: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
        if not self.ready:
            raise ModelNotInitialised("FaceDetector")
        out = self.model.run({"input": I.face_pixels(img)[None]})
        scores, boxes = np.asarray(out["scores"], np.float32).reshape(-1, 2)[:, 1], np.asarray(out["boxes"], np.float32).reshape(-1, 4)
        good = scores > np.float32(self.least)
        scores, boxes = scores[good], boxes[good] * np.float32([img.shape[1], img.shape[0]] * 2)
        keep = I.nms(boxes, scores, self.overlap)
        return [boxes[i] for i in keep], [float(scores[i]) for i in keep]


@dataclass
class OcrConfig:
    thresh: float = 0.3
    box_thresh: float = 0.6
    ratio: float = 1.5
    most: int = 1000
    dilated: bool = False
    limit: int = 960
    kind: str = "max"
    side_limit: int = 4000
    rec_height: int = 48
    rec_batch: int = 1
    rec_least: float = 0.5


def _greedy(probs: np.ndarray, alphabet: Sequence[str]) -> tuple[str, float]:
    c, p = probs.argmax(axis=1), probs.max(axis=1)
    use = [(alphabet[i - 1], float(q)) for t, (i, q) in enumerate(zip(c.tolist(), p.tolist(), strict=True)) if i != 0 and (t == 0 or i != c[t - 1]) and i - 1 < len(alphabet)]
    return "".join(u[0] for u in use), float(np.float32(np.mean([u[1] for u in use]))) if use else 0.0


@dataclass
class TextReader:
    """Detects quads, orders them, reads each crop, and keeps confident texts."""

    detector: Model
    recognizer: Model
    alphabet: list[str]
    config: OcrConfig = field(default_factory=OcrConfig)
    ready: bool = False

    def initialize(self) -> None:
        self.detector.load()
        self.recognizer.load()
        self.ready = True

    def detect(self, img: np.ndarray) -> list[np.ndarray]:
        if not self.ready:
            raise ModelNotInitialised("TextReader")
        if img.ndim != 3 or not img.size:
            raise InvalidInput("an image has height, width and channels")
        c = self.config
        w, h = multiple_of_32(img.shape[1], img.shape[0], c.limit, c.kind, c.side_limit)
        out = next(iter(self.detector.run({"x": I.det_pixels(I.resize_bilinear(img, w, h))[None]}).values()))
        quads = I.text_boxes(np.asarray(out).reshape(h, w), img.shape[1], img.shape[0], c.thresh, c.box_thresh, c.ratio, c.most, c.dilated)
        return [quads[i] for i in I.reading_order([tuple(q[0]) for q in quads])]

    def read(self, img: np.ndarray) -> list[dict]:
        quads, out = self.detect(img), []
        crops = [I.quad_crop(img, q) for q in quads]
        for at in range(0, len(crops), self.config.rec_batch):
            some = crops[at : at + self.config.rec_batch]
            pixels = [I.rec_pixels(x, self.config.rec_height) for x in some]
            wide = max(p.shape[2] for p in pixels)  # narrower ones are filled up to the widest
            got = next(iter(self.recognizer.run({"x": np.stack([np.pad(p, ((0, 0), (0, 0), (0, wide - p.shape[2]))) for p in pixels])}).values()))
            for q, probs in zip(quads[at : at + len(some)], np.asarray(got, np.float32), strict=True):
                text, sure = _greedy(probs, self.alphabet)
                if sure >= self.config.rec_least:
                    out.append({"points": [{"x": float(x), "y": float(y)} for x, y in q], "text": text, "confidence": sure})
        return out


def multiple_of_32(w: int, h: int, limit: int, kind: str, most: int) -> tuple[int, int]:
    ratios = {"max": min(1.0, limit / max(w, h)), "min": max(1.0, limit / min(w, h)), "resize_long": limit / max(w, h)}
    if kind.lower() not in ratios:
        raise ValueError(f"unknown limit type: {kind}")
    nw, nh = int(w * ratios[kind.lower()]), int(h * ratios[kind.lower()])
    if max(nw, nh) > most:
        r = most / max(nw, nh)
        nw, nh = int(nw * r), int(nh * r)
    return max(round(nw / 32) * 32, 32), max(round(nh / 32) * 32, 32)


def embed_rows(df: DataFrame, factory: Callable[[], EmbeddingProvider], item: str = "content", into: str = "embedding") -> DataFrame:
    """df with columns embedding and error; a failed item keeps its row, so rows stay aligned."""
    names = df.columns
    schema = f"{df._jdf.schema().toDDL()}, {into} array<float>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        provider.initialize()
        try:
            for pdf in batches:
                out, errors = [], []
                for x in pdf[item]:
                    try:
                        out.append(provider.embed(x))
                        errors.append(None)
                    except Exception as e:  # noqa: BLE001 - the row carries it
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                yield pdf[names].assign(**{into: pd.Series(out, index=pdf.index, dtype=object), "error": pd.Series(errors, index=pdf.index, dtype=object)})
        finally:
            provider.close()

    return df.mapInPandas(run, schema)


def read_text_rows(df: DataFrame, factory: Callable[[], TextReader], decode: Callable[[Any], np.ndarray], item: str = "content", key: str = "id") -> DataFrame:
    """(id, results, error) of images: results holds points, text and confidence of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = factory()
        reader.initialize()
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[item], strict=True):
                try:
                    rows.append((k, reader.read(decode(x)), None))
                except Exception as e:  # noqa: BLE001 - the row carries it
                    rows.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "results", "error"])

    return df.select(key, item).mapInPandas(run, "id long, results array<struct<points:array<struct<x:float,y:float>>,text:string,confidence:float>>, error string")


def detect_rows(df: DataFrame, factory: Callable[[], FaceDetector], decode: Callable[[Any], np.ndarray], item: str = "content", key: str = "id") -> DataFrame:
    """(id, boxes) of images: boxes holds x1, y1, x2, y2 and score, best first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        detector.initialize()
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[item], strict=True):
                boxes, scores = detector.detect(decode(x))
                rows.append((k, [dict(zip(("x1", "y1", "x2", "y2"), map(float, b), strict=True)) | {"score": s} for b, s in zip(boxes, scores, strict=True)]))
            yield pd.DataFrame(rows, columns=["id", "boxes"])

    return df.select(key, item).mapInPandas(run, "id long, boxes array<struct<x1:float,y1:float,x2:float,y2:float,score:float>>")


class ModelType(str, Enum):
    TEXT = "text"
    IMAGE = "image"
    DETECTOR = "detector"
    OCR = "ocr"


@dataclass(frozen=True)
class ModelInfo:
    name: str
    type: ModelType
    url: str
    path: str
    resources: tuple[str, ...] = ()


class ModelManager:
    """Models of a registry under one folder: import, check, list, delete and open them."""

    def __init__(self, folder: str, registry: dict[str, ModelInfo], fetch: Callable[[str], bytes] | None = None):
        self.folder, self.registry, self.fetch = Path(folder), registry, fetch

    def _info(self, name: str) -> ModelInfo:
        if name not in self.registry:
            raise InvalidModelType(name)
        return self.registry[name]

    def model_file(self, name: str) -> Path:
        path = self.folder / self._info(name).path
        if not path.exists():
            raise ModelNotDownloaded(name)
        return path

    def exists(self, name: str) -> bool:
        """Whether the model and all its resource files are there."""
        info = self._info(name)
        return (self.folder / info.path).exists() and all((self.folder / Path(info.path).parent / r).exists() for r in info.resources)

    def list(self, kind: ModelType | None = None) -> list[str]:
        return [n for n, i in self.registry.items() if (kind is None or i.type is kind) and self.exists(n)]

    def delete(self, name: str) -> bool:
        info = self._info(name)
        gone = False
        for p in (self.folder / info.path, *(self.folder / Path(info.path).parent / r for r in info.resources)):
            if p.exists():
                p.unlink()
                gone = True
        return gone

    def import_file(self, name: str, source: str) -> Path:
        """Takes in a model file, or a zip of exactly the model and its resources."""
        info, source = self._info(name), Path(source)
        target = self.folder / info.path
        target.parent.mkdir(parents=True, exist_ok=True)
        wanted = {target.name, *info.resources}
        if not zipfile.is_zipfile(source) or not info.resources:
            if info.resources:
                raise InvalidModelFile(f"{name} comes as a zip with {sorted(wanted)}")
            shutil.copyfile(source, target)
            return target
        with zipfile.ZipFile(source) as z:
            held = {Path(n).name: n for n in z.namelist() if not n.endswith("/")}
            if set(held) != wanted:
                raise InvalidModelFile(f"{source.name} holds {sorted(held)}, not {sorted(wanted)}")
            for name_, inner in held.items():
                (target.parent / name_).write_bytes(z.read(inner))
        return target

    def download(self, name: str) -> Path:
        if self.fetch is None:
            raise ModelDownloadFailed("no way to fetch was given")
        try:
            data = self.fetch(self._info(name).url)
        except Exception as e:
            raise ModelDownloadFailed(str(e)) from e
        self.folder.mkdir(parents=True, exist_ok=True)
        temp = self.folder / f".{name}.download"
        temp.write_bytes(data)
        try:
            return self.import_file(name, str(temp))
        finally:
            temp.unlink()

    def open(self, name: str) -> OnnxModel:
        return OnnxModel(str(self.model_file(name)))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i.name, i.type.value, i.url, i.path, list(i.resources)) for i in self.registry.values()]
        return spark.createDataFrame(rows, "name string, type string, url string, path string, resources array<string>")
