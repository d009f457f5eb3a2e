"""NumPy image functions and their Arrow-batched operators.

Images are arrays of height x width x 3 bytes (red, green, blue) unless said otherwise.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

IMAGENET_MEAN, IMAGENET_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
CLIP_MEAN, CLIP_STD = (0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711)
HALF_MEAN, HALF_STD = (0.5, 0.5, 0.5), (0.5, 0.5, 0.5)


def resize_nearest(img: np.ndarray, w: int, h: int) -> np.ndarray:
    y = np.minimum((np.arange(h) * img.shape[0]) // h, img.shape[0] - 1)
    x = np.minimum((np.arange(w) * img.shape[1]) // w, img.shape[1] - 1)
    return img[y[:, None], x[None, :]]


def resize_bilinear(img: np.ndarray, w: int, h: int) -> np.ndarray:
    ih, iw = img.shape[:2]
    y = np.clip((np.arange(h) + 0.5) * ih / h - 0.5, 0, ih - 1)
    x = np.clip((np.arange(w) + 0.5) * iw / w - 0.5, 0, iw - 1)
    return np.floor(_bilinear(img.astype(np.float64), *np.meshgrid(x, y)) + 0.5).astype(np.uint8)


def center_crop(img: np.ndarray, size: int) -> np.ndarray:
    """The middle square, scaled by nearest neighbours."""
    h, w = img.shape[:2]
    s = min(h, w)
    y, x = (h - s) // 2, (w - s) // 2
    return resize_nearest(img[y : y + s, x : x + s], size, size)


def crop_boxes(img: np.ndarray, boxes: list) -> list[np.ndarray]:
    """The parts of img under boxes (x1, y1, x2, y2), cut to the image; empty ones are left out."""
    out = []
    for b in boxes:
        x1, y1, x2, y2 = max(0, int(b[0])), max(0, int(b[1])), min(img.shape[1], int(b[2])), min(img.shape[0], int(b[3]))
        if x2 > x1 and y2 > y1:
            out.append(img[y1:y2, x1:x2])
    return out


def draw_boxes(img: np.ndarray, boxes: list, color: tuple[int, int, int], margin: int = 0, stroke: int = 2) -> np.ndarray:
    """A copy with the boxes' outlines."""
    out = img.copy()
    h, w = img.shape[:2]
    for b in boxes:
        x1, y1, x2, y2 = max(0, int(b[0]) - margin), max(0, int(b[1]) - margin), min(w, int(b[2]) + margin), min(h, int(b[3]) + margin)
        lo, hi = stroke // 2, stroke - stroke // 2
        for x in (x1, x2):
            out[max(0, y1 - lo) : y2 + hi, max(0, x - lo) : x + hi] = color
        for y in (y1, y2):
            out[max(0, y - lo) : y + hi, max(0, x1 - lo) : x2 + hi] = color
    return out


def normalized(img: np.ndarray, mean=IMAGENET_MEAN, std=IMAGENET_STD) -> np.ndarray:
    """Channels first, (value / 255 - mean) / std, in single precision."""
    x = img.astype(np.float32) / np.float32(255)
    return np.ascontiguousarray(((x - np.float32(mean)) / np.float32(std)).transpose(2, 0, 1))


def clip_pixels(img: np.ndarray, size: int = 224) -> np.ndarray:
    return normalized(center_crop(img, size), CLIP_MEAN, CLIP_STD)


def dino_pixels(img: np.ndarray, size: int = 224) -> np.ndarray:
    return normalized(center_crop(img, size), IMAGENET_MEAN, IMAGENET_STD)


def inception_pixels(img: np.ndarray, size: int = 160) -> np.ndarray:
    return normalized(center_crop(img, size), HALF_MEAN, HALF_STD)


def face_pixels(img: np.ndarray, w: int = 320, h: int = 240) -> np.ndarray:
    return np.ascontiguousarray(((resize_nearest(img, w, h).astype(np.float32) - np.float32(127)) / np.float32(128)).transpose(2, 0, 1))


def det_pixels(img: np.ndarray, order: str = "BGR", mean=IMAGENET_MEAN, std=IMAGENET_STD) -> np.ndarray:
    """Detection input; channels are swapped unless order is RGB."""
    return normalized(img if order.upper() == "RGB" else img[:, :, ::-1], mean, std)


def rec_pixels(img: np.ndarray, height: int = 48, width: int | None = None) -> np.ndarray:
    """Recognition input: a fixed height, the width in proportion, filled with zeros on the right to width."""
    w = max(1, int(np.ceil(height * img.shape[1] / img.shape[0])))
    w = w if width is None else min(w, width)
    x = normalized(resize_bilinear(img, w, height), HALF_MEAN, HALF_STD)
    return x if width is None else np.pad(x, ((0, 0), (0, 0), (0, width - w)))


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One box against many, in single precision."""
    a, b = np.asarray(a, np.float32), np.asarray(b, np.float32).reshape(-1, 4)
    zero = np.float32(0)
    w = np.maximum(zero, np.minimum(a[2], b[:, 2]) - np.maximum(a[0], b[:, 0]))
    h = np.maximum(zero, np.minimum(a[3], b[:, 3]) - np.maximum(a[1], b[:, 1]))
    area = np.maximum(zero, a[2] - a[0]) * np.maximum(zero, a[3] - a[1])
    other = np.maximum(zero, b[:, 2] - b[:, 0]) * np.maximum(zero, b[:, 3] - b[:, 1])
    union = area + other - w * h
    return np.where(union <= 0, zero, w * h / np.where(union <= 0, np.float32(1), union))


def nms(boxes: np.ndarray, scores: np.ndarray, limit: float) -> list[int]:
    """Kept indices, best score first; a box goes if it overlaps a kept one by more than limit."""
    boxes = np.asarray(boxes, np.float32).reshape(-1, 4)
    left = np.argsort(-np.asarray(scores, np.float32), kind="stable")
    keep = []
    while len(left):
        keep.append(int(left[0]))
        left = left[1:][iou(boxes[left[0]], boxes[left[1:]]) <= np.float32(limit)]
    return keep


def nms_rows(boxes: DataFrame, limit: float) -> DataFrame:
    """(image_id, box_id, rank) of the boxes (image_id, box_id, x1, y1, x2, y2, score) that stay in their image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("box_id").reset_index(drop=True)
        keep = nms(pdf[["x1", "y1", "x2", "y2"]].to_numpy(np.float32), pdf["score"].to_numpy(np.float32), limit)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[keep], "box_id": pdf["box_id"].iloc[keep], "rank": np.arange(len(keep), dtype=np.int32)})

    return boxes.groupBy("image_id").applyInPandas(run, "image_id long, box_id long, rank int")


def reading_order(points: list[tuple[float, float]], band: float = 10.0) -> list[int]:
    """Indices of first corners by y, then x; neighbours within a band of rows go from left to right."""
    out = sorted(range(len(points)), key=lambda i: (points[i][1], points[i][0]))
    for i in range(len(out) - 1):
        j = i
        while j >= 0:
            a, b = points[out[j]], points[out[j + 1]]
            if abs(b[1] - a[1]) < band and b[0] < a[0]:
                out[j], out[j + 1] = out[j + 1], out[j]
                j -= 1
            else:
                break
    return out


def reading_order_rows(boxes: DataFrame, band: float = 10.0) -> DataFrame:
    """(image_id, box_id, position) of boxes (image_id, box_id, x, y)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("box_id").reset_index(drop=True)
        order = reading_order(list(zip(pdf["x"], pdf["y"], strict=True)), band)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[order], "box_id": pdf["box_id"].iloc[order], "position": np.arange(len(order), dtype=np.int32)})

    return boxes.groupBy("image_id").applyInPandas(run, "image_id long, box_id long, position int")


# text detection
def dilate(mask: np.ndarray) -> np.ndarray:
    """Each pixel, or the one above, left, or above left of it."""
    out = mask.copy()
    out[1:] |= mask[:-1]
    out[:, 1:] |= mask[:, :-1]
    out[1:, 1:] |= mask[:-1, :-1]
    return out


def connected(mask: np.ndarray) -> list[np.ndarray]:
    """8-connected components as rows (y, x), in the order of their first pixels."""
    width = mask.shape[1] + 2
    left, out = bytearray(np.pad(mask, 1).tobytes()), []  # with an empty edge
    beside = (-width - 1, -width, 1 - width, -1, 1, width - 1, width, width + 1)
    for first in np.flatnonzero(np.pad(mask, 1)).tolist():
        if not left[first]:
            continue
        left[first] = 0
        queue = [first]
        for at in queue:  # grows meanwhile
            for step in beside:
                if left[at + step]:
                    left[at + step] = 0
                    queue.append(at + step)
        part = np.array(queue)
        out.append(np.stack([part // width - 1, part % width - 1], axis=1))
    return out


def main_axes_rect(part: np.ndarray) -> tuple[float, float, float, float, float]:
    """(cx, cy, w, h, angle) along the main axes; the centre is the mean."""
    y, x = part[:, 0].astype(np.float64), part[:, 1].astype(np.float64)
    cx, cy = x.mean(), y.mean()
    dx, dy = x - cx, y - cy
    angle = 0.5 * np.arctan2(2 * (dx * dy).sum(), (dx * dx).sum() - (dy * dy).sum())
    u, v = dx * np.cos(angle) + dy * np.sin(angle), -dx * np.sin(angle) + dy * np.cos(angle)
    return cx, cy, float(np.ptp(u)), float(np.ptp(v)), float(angle)


def expand_rect(w: float, h: float, ratio: float) -> tuple[float, float]:
    area, edge = w * h, 2 * (w + h)
    d = area * ratio / edge if area > 0 and edge > 0 else 0.0
    return w + 2 * d, h + 2 * d


def corner_order(points: np.ndarray) -> np.ndarray:
    plus, minus = points[:, 0] + points[:, 1], points[:, 0] - points[:, 1]
    return points[[plus.argmin(), minus.argmin(), plus.argmax(), minus.argmax()]]


def quad_order(points: np.ndarray) -> np.ndarray:
    a, b, c, d = points[np.argsort(points[:, 0], kind="stable")]
    tl, bl = (a, b) if b[1] > a[1] else (b, a)
    tr, br = (c, d) if d[1] > c[1] else (d, c)
    return np.array([tl, tr, br, bl])


def text_boxes(
    pred: np.ndarray, width: int, height: int, thresh: float = 0.3, box_thresh: float = 0.6, ratio: float = 1.5, most: int = 1000, dilated: bool = False, score_mode: str = "fast", box_type: str = "quad"
) -> list[np.ndarray]:
    """Quads (four x, y in the image's pixels) from a map of text probabilities."""
    if box_type != "quad":
        raise ValueError("only quads are supported")
    if score_mode.lower() not in ("fast", "slow"):
        raise ValueError(f"unknown score mode: {score_mode}")
    pred = np.asarray(pred, np.float32)
    mask = pred >= np.float32(thresh)
    parts = sorted(connected(dilate(mask) if dilated else mask), key=len, reverse=True)
    sx, sy, out = width / pred.shape[1], height / pred.shape[0], []
    for part in parts[:most]:
        if len(part) < 4 or np.float32(pred[part[:, 0], part[:, 1]].astype(np.float64).mean()) < np.float32(box_thresh):
            continue
        cx, cy, w, h, angle = main_axes_rect(part)
        if min(w, h) < 3:
            continue
        w, h = expand_rect(w, h, float(np.float32(ratio)))
        if min(w, h) < 5:
            continue
        local = np.array([(-w, -h), (w, -h), (w, h), (-w, h)]) / 2
        c, s = np.cos(angle), np.sin(angle)
        points = np.stack([cx + local[:, 0] * c - local[:, 1] * s, cy + local[:, 0] * s + local[:, 1] * c], axis=1).astype(np.float32)
        points = corner_order(points).astype(np.float64)
        scaled = np.stack([np.clip(np.rint(points[:, 0] * sx), 0, width), np.clip(np.rint(points[:, 1] * sy), 0, height)], axis=1)
        if min(np.hypot(*(scaled[1] - scaled[0])), np.hypot(*(scaled[3] - scaled[0]))) > 3:
            out.append(scaled)
    return out


def unclip(points: np.ndarray, ratio: float, steps: int = 8) -> np.ndarray:
    """A polygon grown outward by area * ratio / perimeter with round corners."""
    p = np.asarray(points, np.float64)
    q = np.roll(p, -1, axis=0)
    area = 0.5 * (p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()
    edge = np.hypot(*(q - p).T).sum()
    if abs(area) < 1e-9 or edge < 1e-9:
        return p
    d = abs(area) * ratio / edge
    turn = q - p
    out_n = np.stack([turn[:, 1], -turn[:, 0]], axis=1) * np.sign(area) / np.maximum(np.hypot(*turn.T), 1e-12)[:, None]
    grown = []
    for i in range(len(p)):
        a, b = np.arctan2(*out_n[i - 1][::-1]), np.arctan2(*out_n[i][::-1])
        delta = (b - a + np.pi) % (2 * np.pi) - np.pi
        if delta * np.sign(area) > 0:
            grown += [p[i] + d * np.array([np.cos(t), np.sin(t)]) for t in a + delta * np.linspace(0, 1, steps)]
        else:
            grown.append(p[i] + d * (out_n[i - 1] + out_n[i]) / max(1e-9, 1 + float(out_n[i - 1] @ out_n[i])))
    return np.array(grown)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, np.float64), np.array(right, np.float64)), 1).reshape(3, 3)


def _bilinear(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    return img[y0, x0] * (1 - fx) * (1 - fy) + img[y0, x1] * fx * (1 - fy) + img[y1, x0] * (1 - fx) * fy + img[y1, x1] * fx * fy


def quad_crop(img: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """The straightened part of img under a quad, turned by a quarter if it is tall."""
    q = quad_order(np.asarray(quad, np.float64))
    w = max(1, int(np.floor(max(np.hypot(*(q[1] - q[0])), np.hypot(*(q[2] - q[3]))) + 0.5)))
    h = max(1, int(np.floor(max(np.hypot(*(q[3] - q[0])), np.hypot(*(q[2] - q[1]))) + 0.5)))
    m = homography(np.array([(0, 0), (w, 0), (w, h), (0, h)]), q)
    x, y = np.meshgrid(np.arange(w), np.arange(h))
    p = m @ np.stack([x.ravel(), y.ravel(), np.ones(w * h)])
    out = np.floor(_bilinear(img.astype(np.float64), (p[0] / p[2]).reshape(h, w), (p[1] / p[2]).reshape(h, w)) + 0.5).astype(np.uint8)
    return np.rot90(out).copy() if h / w >= 1.5 else out


def text_box_rows(maps: DataFrame, **options) -> DataFrame:
    """(image_id, box, points) of probability maps (image_id, width, height, map_w, map array<float>)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                pred = np.asarray(r.map, np.float32).reshape(-1, r.map_w)
                rows += [(r.image_id, i, [{"x": float(x), "y": float(y)} for x, y in b]) for i, b in enumerate(text_boxes(pred, r.width, r.height, **options))]
            yield pd.DataFrame(rows, columns=["image_id", "box", "points"])

    return maps.select("image_id", "width", "height", "map_w", "map").mapInPandas(run, "image_id long, box int, points array<struct<x:float,y:float>>")
