"""Substitution and gap models as column expressions, and as numpy for the alignment kernel.

The nucleotide model has a closed form (transition and general rates), so its probabilities are a projection. Protein and
codon models need a rate matrix; they are exponentiated through the eigenvectors of the symmetrised matrix.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sedgeline.functions.sequence import AMINO_ACIDS, BASE_BITS, DNA, STANDARD_CODE


@dataclass(frozen=True)
class GapModel:
    """Rates of insertions and deletions, and the probabilities of going on with a gap within and at the ends."""

    insertion: float
    deletion: float
    extension: float
    end_extension: float


# The presets by molecule.
GAPS = {"dna": GapModel(0.01, 0.01, 0.8, 0.95), "pacbio": GapModel(1.0, 1.0, 0.1, 0.95), "protein": GapModel(0.05, 0.05, 0.5, 0.75), "codon": GapModel(0.01, 0.01, 0.5, 0.75)}


def dna_probability(same: Column, same_class: Column, purine: Column, pi_j: Column, t: Column, pi: tuple[float, float, float, float], kappa: float = 2.0, rho: float = 1.0) -> Column:
    """P(t) from one base to another; ``same_class``: both purines or both pyrimidines; ``purine``: the first is one."""
    beta, alpha_r, alpha_y, r, y = dna_rates(pi, kappa, rho)
    alpha = F.when(purine, alpha_r).otherwise(alpha_y)
    cls = F.when(purine, r).otherwise(y)
    stay = F.when(same, F.exp(-(alpha + beta) * t)).otherwise(0.0)
    within = F.when(same_class, F.exp(-beta * t) * (1 - F.exp(-alpha * t)) * pi_j / cls).otherwise(0.0)
    return stay + within + (1 - F.exp(-F.lit(beta) * t)) * pi_j


def dna_rates(pi: tuple[float, float, float, float], kappa: float = 2.0, rho: float = 1.0) -> tuple[float, float, float, float, float]:
    """General rate, the two transition rates, and the frequencies of purines and pyrimidines; the mean rate is 1."""
    a, c, g, t = pi
    r, y, k = a + g, c + t, kappa / 2
    beta = 1 / (2 * r * y * (1 + k))
    alpha_y = (r * y * k - a * g - c * t) / ((2 + 2 * k) * (y * a * g * rho + r * c * t))
    return beta, rho * alpha_y, alpha_y, r, y


def dna_matrix(t: float, pi: tuple[float, float, float, float], kappa: float = 2.0, rho: float = 1.0) -> np.ndarray:
    """P(t) between A, C, G and T."""
    beta, alpha_r, alpha_y, r, y = dna_rates(pi, kappa, rho)
    out = np.zeros((4, 4))
    for i in range(4):
        alpha, cls = (alpha_r, r) if i % 2 == 0 else (alpha_y, y)
        for j in range(4):
            same_class = i % 2 == j % 2
            out[i, j] = (i == j) * np.exp(-(alpha + beta) * t) + same_class * np.exp(-beta * t) * (1 - np.exp(-alpha * t)) * pi[j] / cls + (1 - np.exp(-beta * t)) * pi[j]
    return out


def dna_rate_matrix(pi: tuple[float, float, float, float], kappa: float = 2.0, rho: float = 1.0) -> np.ndarray:
    """Rates between A, C, G and T; each row sums to 0 and the mean rate is 1."""
    beta, alpha_r, alpha_y, r, y = dna_rates(pi, kappa, rho)
    q = np.array([[beta * pi[j] + (i % 2 == j % 2) * ((alpha_r / r) if i % 2 == 0 else (alpha_y / y)) * pi[j] for j in range(4)] for i in range(4)])
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    return q


def log_odds(p: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """log of the half sum of frequencies times P over the product of frequencies."""
    return np.log(0.5 * (pi[:, None] + pi[None, :]) * p / np.outer(pi, pi))


def dna_scores(t: float, pi: tuple[float, float, float, float] = (0.25,) * 4, factor: float = 1.0) -> np.ndarray:
    """Scores of the 15 letters, in the alphabet's order: the best over what two ambiguous letters may stand for."""
    base = log_odds(dna_matrix(t, pi), np.array(pi))
    members = [[k for k in range(4) if BASE_BITS[letter] >> k & 1] for letter in DNA]
    out = np.empty((15, 15))
    for i, a in enumerate(members):
        for j, b in enumerate(members):
            out[i, j] = base[np.ix_(a, b)].max() + np.log(factor) * ((len(a) > 1) * len(a) + (len(b) > 1) * len(b))
    return out


def reversible_matrix(exchange: np.ndarray, pi: np.ndarray, t: float) -> np.ndarray:
    """P(t) of a reversible model given by symmetric exchangeabilities and frequencies, scaled to a mean rate of 1."""
    q = exchange * pi[None, :]
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    q /= -(pi * np.diag(q)).sum()
    root = np.sqrt(pi)
    values, vectors = np.linalg.eigh(root[:, None] * q / root[None, :])
    return (vectors / root[:, None]) @ np.diag(np.exp(values * t)) @ (vectors.T * root[None, :])


# The published exchangeabilities (one row for each residue, with the ones before it) and frequencies of the
# empirical protein model of Whelan and Goldman (2001), residues in the order ARNDCQEGHILKMFPSTWYV.
_WAG = """
0.551571
0.509848 0.635346
0.738998 0.147304 5.42942
1.02704 0.528191 0.265256 0.030295
0.908598 3.0355 1.54364 0.616783 0.098818
1.58285 0.439157 0.947198 6.17416 0.021352 5.46947
1.41672 0.584665 1.12556 0.865584 0.306674 0.330052 0.567717
0.316954 2.13715 3.95629 0.930676 0.248972 4.29411 0.570025 0.24941
0.193335 0.186979 0.554236 0.039437 0.170135 0.113917 0.127395 0.03045 0.13819
0.397915 0.497671 0.131528 0.084805 0.384287 0.869489 0.154263 0.061304 0.499462 3.17097
0.906265 5.35142 3.01201 0.479855 0.074034 3.8949 2.58443 0.373558 0.890432 0.323832 0.257555
0.893496 0.683162 0.198221 0.103754 0.390482 1.54526 0.315124 0.1741 0.404141 4.25746 4.85402 0.934276
0.210494 0.102711 0.096162 0.04673 0.39802 0.099921 0.081134 0.049931 0.679371 1.05947 2.11517 0.088836 1.19063
1.43855 0.679489 0.195081 0.423984 0.109404 0.933372 0.682355 0.24357 0.696198 0.099929 0.415844 0.556896 0.171329 0.161444
3.37079 1.22419 3.97423 1.07176 1.40766 1.02887 0.704939 1.34182 0.740169 0.31944 0.344739 0.96713 0.493905 0.545931 1.61328
2.12111 0.554413 2.03006 0.374866 0.512984 0.857928 0.822765 0.225833 0.473307 1.45816 0.326622 1.38698 1.51612 0.171903 0.795384 4.37802
0.113133 1.16392 0.071917 0.129767 0.71707 0.215737 0.156557 0.336983 0.262569 0.212483 0.665309 0.137505 0.515706 1.52964 0.139405 0.523742 0.110864
0.240735 0.381533 1.086 0.325711 0.543833 0.22771 0.196303 0.103604 3.87344 0.42017 0.398618 0.133264 0.428437 6.45428 0.216046 0.786993 0.291148 2.48539
2.00601 0.251849 0.196246 0.152335 1.00214 0.301281 0.588731 0.187247 0.118358 7.8213 1.80034 0.305434 2.05845 0.649892 0.314887 0.232739 1.38823 0.365369 0.31473
0.0866279 0.043972 0.0390894 0.0570451 0.0193078 0.0367281 0.0580589 0.0832518 0.0244313 0.048466 0.086209 0.0620286 0.0195027 0.0384319 0.0457631 0.0695179 0.0610127 0.0143859 0.0352742 0.0708956
"""


def read_exchange(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric exchangeabilities and frequencies from a published model's usual text: a lower triangle, then the frequencies."""
    numbers = [float(x) for x in text.split()]
    n = int(np.sqrt(2 * len(numbers)))  # n (n - 1) / 2 + n numbers
    while n * (n + 1) // 2 > len(numbers):
        n -= 1
    exchange = np.zeros((n, n))
    exchange[np.tril_indices(n, -1)] = numbers[: n * (n - 1) // 2]
    pi = np.array(numbers[n * (n - 1) // 2 : n * (n + 1) // 2])
    return exchange + exchange.T, pi / pi.sum()


def protein_model() -> tuple[np.ndarray, np.ndarray]:
    return read_exchange(_WAG)


#: Codons without stops, in the order of TCAG.
CODONS = [a + b + c for (a, b, c), r in zip(((a, b, c) for a in "TCAG" for b in "TCAG" for c in "TCAG"), STANDARD_CODE, strict=True) if r != "*"]


def codon_model(kappa: float = 2.0, omega: float = 0.5, pi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exchangeabilities and frequencies of codons: one base changes at a time, ``kappa`` times faster within purines and pyrimidines,
    ``omega`` times as fast where the residue changes. An empirical matrix, whose 1,830 values are read by ``read_exchange``, may be used instead."""
    residue = dict(zip((a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"), STANDARD_CODE, strict=True))
    n = len(CODONS)
    exchange = np.zeros((n, n))
    for i, x in enumerate(CODONS):
        for j, y in enumerate(CODONS):
            changed = [{p, q} for p, q in zip(x, y, strict=True) if p != q]
            if len(changed) == 1:
                exchange[i, j] = (kappa if changed[0] in ({"A", "G"}, {"C", "T"}) else 1.0) * (omega if residue[x] != residue[y] else 1.0)
    return exchange, np.full(n, 1 / n) if pi is None else np.asarray(pi) / np.sum(pi)


class Alphabet:
    """The states of a molecule: its plain tokens, one that stands for anything, and those that stand for sets of plain ones.

    Nucleotides have the 15 sets of bases. Residues and codons have all pairs: what a parent of two that differ may be.
    """

    def __init__(self, name: str, tokens: list[str], anything: str, exchange: np.ndarray, pi: np.ndarray) -> None:
        self.name, self.tokens, self.exchange, self.pi = name, tokens, exchange, pi
        k = len(tokens)
        self.unit = len(tokens[0])
        i, j = np.triu_indices(k, 1)
        self.first = np.concatenate([np.arange(k), [0], i])
        self.second = np.concatenate([np.arange(k), [k - 1], j])
        self.anything = k
        self.number = {t: n for n, t in enumerate(tokens)} | {anything: k}
        self._pair = np.zeros((k, k), np.int64)
        self._pair[i, j] = self._pair[j, i] = np.arange(len(i)) + k + 1
        np.fill_diagonal(self._pair, np.arange(k))

    def states(self, seq: str) -> np.ndarray:
        """Numbers of a sequence's tokens; unknown ones stand for anything. A last token that isn't whole is left out."""
        u = self.unit
        return np.array([self.number.get(seq[i : i + u], self.anything) for i in range(0, len(seq) - u + 1, u)], np.int64)

    def scores(self, t: float) -> np.ndarray:
        """Log odds of all pairs of states: the best over what they may stand for."""
        base = log_odds(np.maximum(reversible_matrix(self.exchange, self.pi, t), 1e-300), self.pi)
        wide = np.maximum(base[self.first], base[self.second])
        wide[self.anything] = base.max(0)
        out = np.maximum(wide[:, self.first], wide[:, self.second])
        out[:, self.anything] = wide.max(1)
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Parsimony: what both may be, else the two together; of sets that can't be named together the pair that exchanges most."""
        a, b = np.broadcast_arrays(a, b)
        a1, a2, b1, b2 = self.first[a], self.second[a], self.first[b], self.second[b]
        anything = self.anything
        rates = np.stack([self.exchange[x, y] for x in (a1, a2) for y in (b1, b2)])
        pairs = np.stack([self._pair[x, y] for x in (a1, a2) for y in (b1, b2)])
        out = np.take_along_axis(pairs, rates.argmax(0)[None], 0)[0]
        for x in (a1, a2):
            out = np.where((x == b1) | (x == b2), x, out)
        both = (np.minimum(a1, a2) == np.minimum(b1, b2)) & (np.maximum(a1, a2) == np.maximum(b1, b2))
        out = np.where(both, a, out)
        return np.where(a == anything, b, np.where(b == anything, a, out))

    def below(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """A child's state in the light of its parent's: what both may be, else the child's own."""
        out = child
        for x in (self.first[parent], self.second[parent]):
            out = np.where(((x == self.first[child]) | (x == self.second[child])) & (parent != self.anything) & (child != self.anything), x, out)
        return np.where(child == self.anything, parent, np.where(parent == child, child, out))

    def likely(self, state: np.ndarray) -> np.ndarray:
        """The plain token that a state most probably is: the one of the two with the higher frequency."""
        a, b = self.first[state], self.second[state]
        return np.where(np.asarray(state) == self.anything, self.anything, np.where(self.pi[a] > self.pi[b], a, b))


PROTEIN = Alphabet("protein", list(AMINO_ACIDS), "X", *protein_model())


def codon_alphabet(kappa: float = 2.0, omega: float = 0.5) -> Alphabet:
    return Alphabet("codon", CODONS, "NNN", *codon_model(kappa, omega))


def gap_open(t: Column, gaps: GapModel = GAPS["dna"]) -> Column:
    """Probability that a gap opens on a branch."""
    return 1 - F.exp(-0.5 * (gaps.insertion + gaps.deletion) * t)


def gap_logs(t: float, gaps: GapModel = GAPS["dna"]) -> tuple[float, float, float, float]:
    """Logs of no gap, gap opening, going on, and going on at an end."""
    opening = 1 - np.exp(-0.5 * (gaps.insertion + gaps.deletion) * t)
    return float(np.log(1 - 2 * opening)), float(np.log(opening)), float(np.log(gaps.extension)), float(np.log(gaps.end_extension))
