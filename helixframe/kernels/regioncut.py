"""Cuts a run of smoothed activity into regions of at most 300 positions."""

from __future__ import annotations

LEAST, MOST, THRESHOLD = 50, 300, 0.002


def best_cut(profile: list[float], least: int = LEAST, most: int = MOST) -> int:
    """Offset of the last position of the first part: the least local minimum from the end, else the longest part.

    ``profile`` may be longer than ``most``, so that the position after the last offset can be seen.
    """
    best, value = most - 1, None
    for i in range(min(most, len(profile)) - 1, least - 2, -1):
        if i < 1 or i + 1 >= len(profile):
            continue
        if profile[i] <= profile[i + 1] and profile[i] < profile[i - 1] and (value is None or profile[i] < value):
            best, value = i, profile[i]
    return best


def cut(positions: list[int], profile: list[float], threshold: float = THRESHOLD, least: int = LEAST, most: int = MOST) -> list[tuple[int, int, bool]]:
    """(start, end, active) for positions in order: states change, gaps and the greatest length close a region."""
    out: list[tuple[int, int, bool]] = []
    at, n = 0, len(positions)
    while at < n:
        active = profile[at] > threshold
        end = at
        while end + 1 < n and positions[end + 1] == positions[end] + 1 and (profile[end + 1] > threshold) == active and end - at + 1 < most:
            end += 1
        full = end - at + 1 == most and end + 1 < n and positions[end + 1] == positions[end] + 1 and (profile[end + 1] > threshold) == active
        if active and full:
            end = at + best_cut(profile[at : end + 2], least, most)
        out.append((positions[at], positions[end], active))
        at = end + 1
    return out
