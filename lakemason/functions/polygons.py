"""Plane geometry for region joins: ear clipping, bounding-volume hierarchies, exact tests."""

from __future__ import annotations

import math

import numpy as np

EARTH_M = 6_371_000.0


def haversine_m(lat1, lon1, lat2, lon2):
    """Great-circle metres on a sphere of radius 6,371 km; arrays or numbers in degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lon2, lon1)) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def disc(lat: float, lon: float, radius_m: float, sides: int = 12) -> list[tuple[float, float]]:
    """A polygon (x = lon, y = lat) that contains the whole disc around a point.

    The corners lie outside the circle so far that the sides touch it, with 1 % to spare for
    the flattening of the plane. Near a pole the width grows with 1 / cos(latitude).
    """
    reach = radius_m * 1.01 / math.cos(math.pi / sides)
    dy = math.degrees(reach / EARTH_M)
    dx = dy / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + dy))))
    return [(lon + dx * math.cos(2 * math.pi * i / sides), lat + dy * math.sin(2 * math.pi * i / sides)) for i in range(sides)]


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple]:
    """Triangles that cover a simple polygon exactly; [] for less than three distinct corners."""
    points = [p for i, p in enumerate(ring) if p != ring[i - 1]]
    if len(points) < 3:
        return []
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)) < 0:
        points.reverse()
    out = []
    while len(points) > 3:
        n = len(points)
        for i in range(n):
            a, b, c = points[i - 1], points[i], points[(i + 1) % n]
            turn = _cross(a, b, c)
            if turn < 0:
                continue
            rest = (p for p in points if p not in (a, b, c))
            if turn == 0 or not any(_cross(a, b, p) >= 0 and _cross(b, c, p) >= 0 and _cross(c, a, p) >= 0 for p in rest):
                if turn > 0:
                    out.append((a, b, c))
                points.pop(i)
                break
        else:  # a ring that crosses itself: cut where we stand, so that the loop ends
            out.append((points[-1], points[0], points[1]))
            points.pop(0)
    if _cross(*points) != 0:
        out.append(tuple(points))
    return out


class TriangleTree:
    """A bounding-volume hierarchy over triangles; finds all triangles that hold each point."""

    LEAF = 8

    def __init__(self, triangles: np.ndarray) -> None:
        """triangles: n x 3 x 2, corners counter-clockwise."""
        self.triangles = triangles
        self.nodes: list[tuple] = []
        if len(triangles):
            lo, hi = triangles.min(axis=1), triangles.max(axis=1)
            self._build(np.arange(len(triangles)), lo, hi)

    def _build(self, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        box = lo[ids].min(axis=0), hi[ids].max(axis=0)
        if len(ids) <= self.LEAF:
            self.nodes[at] = (*box, ids, -1, -1)
            return at
        axis = int(np.argmax(box[1] - box[0]))
        order = ids[np.argsort((lo[ids, axis] + hi[ids, axis]), kind="stable")]
        left = self._build(order[: len(order) // 2], lo, hi)
        right = self._build(order[len(order) // 2 :], lo, hi)
        self.nodes[at] = (*box, None, left, right)
        return at

    def locate(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point positions, triangle positions) of every point in or on every triangle."""
        points, found = [], []
        stack = [(0, np.arange(len(x)))] if self.nodes else []
        while stack:
            node, at = stack.pop()
            lo, hi, ids, left, right = self.nodes[node]
            px, py = x[at], y[at]
            at = at[(px >= lo[0]) & (px <= hi[0]) & (py >= lo[1]) & (py <= hi[1])]
            if not len(at):
                continue
            if ids is None:
                stack += [(left, at), (right, at)]
                continue
            px, py = x[at], y[at]
            for t in ids:
                (ax, ay), (bx, by), (cx, cy) = self.triangles[t]
                inside = ((bx - ax) * (py - ay) - (by - ay) * (px - ax) >= 0) & ((cx - bx) * (py - by) - (cy - by) * (px - bx) >= 0) & ((ax - cx) * (py - cy) - (ay - cy) * (px - cx) >= 0)
                if inside.any():
                    points.append(at[inside])
                    found.append(np.full(int(inside.sum()), t))
        if not points:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(points), np.concatenate(found)
