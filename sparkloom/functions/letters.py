"""Scalar functions of letters, paths, distances and confidences as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
NUCLEO = "ACGT"
SYMBOLS = "___.,/:=@*^"
# Dayhoff's estimates of percent accepted mutations for 75.0 % to 93.0 % observed differences, in steps of 0.1 %.
DAYHOFF_PAMS = [
    int(v)
    for v in """
195 196 197 198 199 200 200 201 202 203 204 205 206 207 208 209 209 210 211 212
213 214 215 216 217 218 219 220 221 222 223 224 226 227 228 229 230 231 232 233
234 236 237 238 239 240 241 243 244 245 246 248 249 250 252 253 254 255 257 258
260 261 262 264 265 267 268 270 271 273 274 276 277 279 281 282 284 285 287 289
291 292 294 296 298 299 301 303 305 307 309 311 313 315 317 319 321 323 325 328
330 332 335 337 339 342 344 347 349 352 354 357 360 362 365 368 371 374 377 380
383 386 389 393 396 399 403 407 410 414 418 422 426 430 434 438 442 447 451 456
461 466 471 476 482 487 493 498 504 511 517 524 531 538 545 553 560 569 577 586
595 605 615 626 637 649 661 675 688 703 719 736 754 775 796 819 845 874 907 945
988
""".split()
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_gap(c: Column | str) -> Column:
    return col(c).isin("-", ".")


def is_upper(c: Column | str) -> Column:
    return ~is_gap(c) & (col(c) != F.lower(col(c)))


def is_lower(c: Column | str) -> Column:
    return ~is_gap(c) & (col(c) != F.upper(col(c)))


def strip_gaps(row: Column | str) -> Column:
    return F.translate(col(row), "-.", "")


def letter_code(c: Column | str, alphabet: str = AMINO) -> Column:
    """0-based place in the alphabet, null for other letters."""
    at = F.instr(F.lit(alphabet), F.upper(col(c)))
    return F.when(at > 0, at - 1).cast("bigint")


def letter_pairs(row: Column | str) -> Column:
    """Array of single letters; empty for an empty row."""
    return F.filter(F.split(col(row), ""), lambda c: c != "")


def invert_path(path: Column | str) -> Column:
    """Swap the two sides of a B/X/Y path."""
    return F.translate(col(path), "XY", "YX")


def accession(label: Column | str) -> Column:
    """The part of a label up to white space, or the middle field of `a|b|c`."""
    first = F.regexp_extract(col(label), r"^(\S*)", 1)
    return F.when(first.contains("|"), F.element_at(F.split(first, r"\|"), 2)).otherwise(first)


def kimura(p: Column | str) -> Column:
    """Kimura's correction of a fraction p of differing places, from 0.75 on by Dayhoff's table; 10 above 0.93."""
    p = col(p)
    known = F.element_at(F.array(*(F.lit(v) for v in DAYHOFF_PAMS)), (F.floor((p - 0.75) * 1000 + 0.5) + 1).cast("int")) / 100.0
    return F.when(p > 0.93, F.lit(10.0)).when(p < 0.75, -F.log(1 - p - p * p / 5)).otherwise(known)


def confidence_symbol(c: Column | str) -> Column:
    return F.substring(F.lit(SYMBOLS), 1 + F.floor(10 * col(c)).cast("int"), F.lit(1))


def confidence_bin(c: Column | str) -> Column:
    return F.floor(10 * col(c)).cast("bigint")


def percent(a: Column | str, b: Column | str) -> Column:
    return F.when(col(b) != 0, 100.0 * col(a) / col(b))


def interval_overlap(lo1, hi1, lo2, hi2) -> Column:
    return F.greatest(F.lit(0), F.least(col(hi1), col(hi2)) - F.greatest(col(lo1), col(lo2)) + 1)


def interpolate(x: Column | str, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the points, flat outside."""
    x, out = col(x), F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < x1, F.lit(y0) + (x - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
    return F.when(x < points[0][0], F.lit(points[0][1])).otherwise(out)
