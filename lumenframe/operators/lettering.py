"""Short labels on images: glyphs of 5 x 7 points, enlarged, on a filled bar, clipped to the image."""

from __future__ import annotations

import functools

import numpy as np

#: Glyphs as five columns of seven points, the lowest bit on top. Small letters are drawn as capitals.
GLYPHS = """
0 3E5149453E
1 00427F4000
2 4261514946
3 2141454B31
4 1814127F10
5 2745454539
6 3C4A494930
7 0171090503
8 3649494936
9 064949291E
A 7E1111117E
B 7F49494936
C 3E41414122
D 7F4141221C
E 7F49494941
F 7F09090901
G 3E4149497A
H 7F0808087F
I 00417F4100
J 2040413F01
K 7F08142241
L 7F40404040
M 7F020C027F
N 7F0408107F
O 3E4141413E
P 7F09090906
Q 3E4151215E
R 7F09192946
S 4649494931
T 01017F0101
U 3F4040403F
V 1F2040201F
W 3F4038403F
X 6314081463
Y 0708700807
Z 6151494543
. 0060600000
, 0050300000
: 0036360000
- 0808080808
_ 4040404040
/ 2010080402
# 147F147F14
% 2313086462
( 001C224100
) 0041221C00
+ 08083E0808
? 0201510906
"""
ROWS, COLUMNS = 7, 5


@functools.cache
def _glyphs() -> dict[str, np.ndarray]:
    known = {}
    for line in GLYPHS.split("\n"):
        if line:
            name, columns = line.split(" ")
            known[name] = np.array([list(bytes.fromhex(columns))]).repeat(ROWS, 0) >> np.arange(ROWS)[:, None] & 1
    return known


def glyphs(text: str) -> np.ndarray:
    """The points of a text, one column between letters and none around them; what has no glyph is a question mark."""
    parts = []
    for c in text.upper():
        parts.append(np.zeros((ROWS, COLUMNS), int) if c.isspace() else _glyphs().get(c, _glyphs()["?"]))
        parts.append(np.zeros((ROWS, 1), int))
    return np.concatenate(parts[:-1], 1).astype(bool) if parts else np.zeros((ROWS, 0), bool)


def draw_label(array: np.ndarray, box, text: str, colour=(0, 255, 0), ink=(0, 0, 0), size: int = 1) -> np.ndarray:
    """A copy with ``text`` on a bar that stands on the box's upper left corner.

    The bar has a margin of one point on each side; where there is no room above, it
    hangs below that edge. What is beyond the image is cut off.
    """
    out = np.array(array, copy=True)
    points = np.kron(np.pad(glyphs(text), 1), np.ones((size, size), bool))
    x, y = int(box[0]), int(box[1])
    y = y - len(points) if y >= len(points) else y
    h, w = out.shape[:2]
    top, left = max(0, -y), max(0, -x)
    seen = points[top : max(top, h - y), left : max(left, w - x)]
    if seen.size:
        ys, xs = slice(y + top, y + top + seen.shape[0]), slice(x + left, x + left + seen.shape[1])
        out[ys, xs] = np.where(seen[:, :, None], np.array(ink, np.uint8)[: out.shape[2]], np.array(colour, np.uint8)[: out.shape[2]])
    return out
