"""Numeric kernels in NumPy, for what Spark has no builtin: special functions, exact match probabilities and small fits."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np



def lgamma(x) -> np.ndarray:
    """log gamma of positive numbers: shifted up to 10, then Stirling's series, for whole arrays."""
    x = np.array(x, float, ndmin=1, copy=True)
    shift = np.zeros_like(x)
    while (low := x < 10).any():
        shift[low] += np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    out = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x - shift
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 10, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def betaln(a, b):
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + b)


def beta_binomial_logpmf(k, n, mean, concentration):
    a, b = mean * concentration, (1 - mean) * concentration
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0) + betaln(k + a, n - k + b) - betaln(a, b)


def normal_quantile(p: float) -> float:
    """Bisection on erfc, to the last bits."""
    if not 0 < p < 1:
        return math.copysign(math.inf, p - 0.5)
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def hold(p: float) -> float:
    q = 1 - p
    return p**4 * (1 + 4 * q + 10 * q * q) + 20 * p**3 * q**3 * p * p / (p * p + q * q)


def tiebreak(pa: float, pb: float, target: int = 7, first: int = 0) -> float:
    """Probability that the first player wins a tiebreak; pa and pb are the points that each wins on service."""
    level = pa * (1 - pb) / (pa * (1 - pb) + (1 - pa) * pb) if 0 < pa + pb < 2 else 0.5

    @lru_cache(maxsize=None)
    def at(a: int, b: int) -> float:
        if a >= target - 1 and b >= target - 1 and a == b:
            return level
        if a >= target:
            return 1.0
        if b >= target:
            return 0.0
        server = (first + (a + b + 1) // 2) % 2
        p = pa if server == 0 else 1 - pb
        return p * at(a + 1, b) + (1 - p) * at(a, b + 1)

    return at(0, 0)


def set_outcomes(pa: float, pb: float, first: int, target: int = 7) -> tuple[dict[tuple[int, int], float], dict[int, float]]:
    """Probability of each score of a set, and by the next server that the first player wins it."""
    ha, hb = hold(pa), hold(pb)
    scores: dict[tuple[int, int], float] = {}
    wins = {0: 0.0, 1: 0.0}
    layer = {(0, 0): 1.0}
    while layer:
        after: dict[tuple[int, int], float] = {}
        for (a, b), w in layer.items():
            server = (first + a + b) % 2
            if (a, b) == (6, 6):
                won = tiebreak(pa, pb, target, server)
                scores[7, 6], scores[6, 7] = scores.get((7, 6), 0) + w * won, scores.get((6, 7), 0) + w * (1 - won)
                wins[(first + 13) % 2] += w * won
                continue
            p = ha if server == 0 else 1 - hb
            for (x, y), v in (((a + 1, b), w * p), ((a, b + 1), w * (1 - p))):
                if max(x, y) >= 6 and abs(x - y) >= 2 or max(x, y) == 7:
                    scores[x, y] = scores.get((x, y), 0) + v
                    wins[(first + x + y) % 2] += v if x > y else 0
                else:
                    after[x, y] = after.get((x, y), 0) + v
        layer = after
    return scores, wins


def match_win(pa: float, pb: float, best_of: int = 3, first: int | None = None, last_target: int = 10) -> float:
    """Probability that the first player wins the match; the mean over both first servers if it is unknown."""
    if first is None:
        return (match_win(pa, pb, best_of, 0, last_target) + match_win(pa, pb, best_of, 1, last_target)) / 2
    need = best_of // 2 + 1

    @lru_cache(maxsize=None)
    def at(a: int, b: int, server: int) -> float:
        if a == need or b == need:
            return float(a == need)
        scores, _ = set_outcomes(pa, pb, server, last_target if a == b == need - 1 else 7)
        return sum(w * at(a + (x > y), b + (x < y), (server + x + y) % 2) for (x, y), w in scores.items())

    return at(0, 0, first)


def newton(x: np.ndarray, y: np.ndarray, offset: np.ndarray | float = 0.0, ridge: float = 0.0, lower: float = -np.inf, upper: float = np.inf, weight: np.ndarray | float = 1.0, rounds: int = 100) -> np.ndarray:
    """Logistic regression with an offset, a ridge and a box, by projected Newton steps with halving."""
    w = np.clip(np.zeros(x.shape[1]), lower, upper)
    weight = np.broadcast_to(weight, len(y)).astype(float)

    def loss(v):
        z = offset + x @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge * v @ v)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -35, 35)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-10) * np.eye(len(w))
        # Coordinates that lie on the box and would leave it stay.
        free = ~(((w <= lower) & (g > 0)) | ((w >= upper) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < 1e-9:
            break
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        size, now = 1.0, loss(w)
        while size > 1e-8 and loss(np.clip(w - size * step, lower, upper)) > now:
            size /= 2
        new = np.clip(w - size * step, lower, upper)
        if np.allclose(new, w, rtol=0, atol=1e-12):
            break
        w = new
    return w


def calibration(p: np.ndarray, y: np.ndarray, clip: float = 1e-6) -> tuple[float, float] | None:
    """Intercept and slope of the outcome on the forecast's logit; None for fewer than ten rows or one class."""
    if len(y) < 10 or len(set(np.asarray(y).tolist())) < 2:
        return None
    q = np.clip(p, clip, 1 - clip)
    w = newton(np.c_[np.ones(len(q)), np.log(q / (1 - q))], np.asarray(y, float))
    return float(w[0]), float(w[1])


def beta_binomial_map(k: np.ndarray, n: np.ndarray, weight: np.ndarray, prior_sd: float = 2.0, rounds: int = 200) -> tuple[float, float]:
    """Weighted maximum a posteriori of logit mean and log concentration, by Newton steps on differences."""

    def loss(v):
        mean, kappa = 1 / (1 + math.exp(-v[0])), math.exp(v[1])
        return -float(weight @ beta_binomial_logpmf(k, n, mean, kappa)) + (v[0] ** 2 / (2 * prior_sd**2)) + ((v[1] - math.log(50)) ** 2 / (2 * prior_sd**2))

    v = np.array([math.log((weight @ k + 0.5) / (weight @ (n - k) + 0.5)), math.log(50.0)])
    for _ in range(rounds):
        e = 1e-4
        g = np.array([(loss(v + d) - loss(v - d)) / (2 * e) for d in np.eye(2) * e])
        h = np.array([[(loss(v + a + b) - loss(v + a - b) - loss(v - a + b) + loss(v - a - b)) / (4 * e * e) for b in np.eye(2) * e] for a in np.eye(2) * e])
        step = np.linalg.solve(h, g) if np.linalg.eigvalsh(h).min() > 1e-9 else g / max(1.0, np.abs(g).max())
        size, now = 1.0, loss(v)
        while size > 1e-6 and loss(v - size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-7:
            break
        v = v - size * step
    return float(v[0]), float(v[1])


def confidence_sequence(successes: int, trials: int, level: float = 0.95, a: float = 0.5, b: float = 0.5) -> tuple[float, float]:
    """Interval of a beta-binomial mixture martingale, valid at every number of trials; 80 halvings on each side."""
    if not trials:
        return 0.0, 1.0
    head = math.lgamma(successes + a) + math.lgamma(trials - successes + b) - math.lgamma(trials + a + b) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))

    def over(p: float) -> bool:
        own = (successes * math.log(p) if successes else 0.0) + ((trials - successes) * math.log1p(-p) if trials > successes else 0.0)
        return head - own >= -math.log(1 - level)

    mid, ends = successes / trials, []
    for edge in (1e-15, 1 - 1e-15):
        out, inside = edge, min(max(mid, 1e-12), 1 - 1e-12)
        if not over(out):
            ends.append(0.0 if edge < 0.5 else 1.0)
            continue
        for _ in range(80):
            p = (out + inside) / 2
            out, inside = (p, inside) if over(p) else (out, p)
        ends.append(out)
    return ends[0], ends[1]


def descending(start: np.ndarray, rounds: int = 500, memory: int = 12, tolerance: float = 1e-6, longest=None):
    """A generator that asks for (value, gradient) at the points it yields and returns a local minimum, by quasi-Newton steps of limited memory.
    longest: the size of step that a direction allows; if given, the curvature is about 1 on all axes, so that the first step is the gradient itself."""
    x = start.astype(float)
    value, gradient = yield x
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if np.abs(gradient).max() <= tolerance * max(1.0, abs(value)):
            break
        q, scales = gradient.copy(), []
        for s, y, rho in reversed(past):
            scales.append(rho * (s @ q))
            q -= scales[-1] * y
        if past:
            s, y, _ = past[-1]
            q *= (s @ y) / (y @ y)
        elif longest is None:
            q /= max(1.0, np.linalg.norm(gradient))
        for (s, y, rho), scale in zip(past, reversed(scales), strict=True):
            q += (scale - rho * (y @ q)) * s
        slope = -(gradient @ q)
        if slope >= 0:
            q, slope, past = gradient / max(1.0, np.linalg.norm(gradient)), -np.linalg.norm(gradient), []
        size = 1.0 if longest is None else min(1.0, longest(q))
        while True:
            new_value, new_gradient = yield x - size * q
            if np.isfinite(new_value) and new_value <= value + 1e-4 * size * slope or size < 1e-12:
                break
            size /= 2
        s, y = -size * q, new_gradient - gradient
        done = abs(value - new_value) <= 1e-13 * max(1.0, abs(value))
        x, value, gradient = x + s, new_value, new_gradient
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        if done or size < 1e-12:
            break
    return x


def driven(steps, objective) -> np.ndarray:
    """The end of a generator of steps whose questions objective answers."""
    x = next(steps)
    while True:
        try:
            x = steps.send(objective(x))
        except StopIteration as e:
            return e.value


def descent(objective, start: np.ndarray, rounds: int = 500, memory: int = 12, tolerance: float = 1e-6) -> np.ndarray:
    """descending() of an objective that gives value and gradient."""
    return driven(descending(start, rounds, memory, tolerance), objective)


#: Standard deviations of the priors of coefficients, paces and the rest, and where sigma0, sigma1 and nu begin.
STUDENT_SD, STUDENT_START = (50.0, 5.0, 1.0), (2.0, 0.5, 8.0)


def student_sums(v: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, players: int) -> np.ndarray:
    """What matches add to the objective of student_objective() at v and to its gradient: sums, so those of parts of the matches add up."""
    k, root = x.shape[1], np.sqrt(np.maximum(x[:, 1], 1.0))
    beta, pace = v[:k], v[k : k + players] - v[k : k + players].mean()
    s0, s1, m = np.exp(np.clip(v[k + players :], -20, 20))
    nu, scale = 2 + m, s0 + s1 * root
    error = y - x @ beta - pace[a] - pace[b]
    u = (error / scale) ** 2
    density = lgamma((nu + 1) / 2)[0] - lgamma(nu / 2)[0] - 0.5 * math.log(nu * math.pi) - np.log(scale) - (nu + 1) / 2 * np.log1p(u / nu)
    pull = weight * (nu + 1) * error / (nu * scale**2 + error**2)
    spread = weight * (1 - (nu + 1) * u / (nu + u)) / scale
    half = digamma(np.array([(nu + 1) / 2, nu / 2]))
    free = -0.5 * half[0] + 0.5 * half[1] + 0.5 / nu + 0.5 * np.log1p(u / nu) - (nu + 1) * u / (2 * nu * (nu + u))
    each = np.bincount(a, pull, players) + np.bincount(b, pull, players)
    return np.concatenate([[weight @ density], x.T @ pull, each, [spread.sum() * s0, (spread @ root) * s1, (weight @ free) * m]])


def student_objective(v: np.ndarray, sums: np.ndarray, k: int, players: int) -> tuple[float, np.ndarray]:
    """Value and exact gradient of the negative weighted log density of Student-t errors and normal priors, from the sums over all matches."""
    beta_sd, pace_sd, residual_sd = STUDENT_SD
    beta, pace = v[:k], v[k : k + players] - v[k : k + players].mean()
    rest = v[k + players :] - _student_mid()
    value = -sums[0] + 0.5 * (beta @ beta) / beta_sd**2 + 0.5 * (pace @ pace) / pace_sd**2 + 0.5 * (rest @ rest) / residual_sd**2
    each = pace / pace_sd**2 - sums[1 + k : 1 + k + players]
    return float(value), np.concatenate([-sums[1 : 1 + k] + beta / beta_sd**2, each - each.mean(), sums[1 + k + players :] + rest / residual_sd**2])


def _student_mid() -> np.ndarray:
    return np.log(np.array([STUDENT_START[0], STUDENT_START[1], STUDENT_START[2] - 2]))


def student_steps(xx: np.ndarray, xy: np.ndarray, games: np.ndarray, spreads: np.ndarray):
    """A generator of the points at which the fit asks for student_objective(); it returns the mode.

    It begins at least squares and steps on axes on which the curvature there is about 1, so that few points do. Its moments are sums over
    matches at the first scale s = s0 + s1 * root: of w / s^2 times products of x (xx), x times y (xy), of w / s^2 by player (games), and of w times
    1, s0^2 / s^2, s0 s1 root / s^2 and s1^2 root^2 / s^2 (spreads)."""
    k, players = len(xy), len(games)
    beta_sd, pace_sd, residual_sd = STUDENT_SD
    curve = xx + np.eye(k) / beta_sd**2
    n, first, both, second = spreads
    tail = np.array([[2 * first, 2 * both, 0], [2 * both, 2 * second, 0], [0, 0, 0.03 * n]]) + np.eye(3) / residual_sd**2
    start = np.concatenate([np.linalg.solve(curve, xy), np.zeros(players), _student_mid()])
    turn = np.zeros((k, k)), np.zeros((3, 3))
    for out, c in zip(turn, (curve, tail), strict=True):
        out[:] = np.linalg.inv(np.linalg.cholesky(c)).T if np.isfinite(c).all() else np.eye(len(c))
    width = 1 / np.sqrt(games + 1 / pace_sd**2)
    there = lambda z: start + np.concatenate([turn[0] @ z[:k], width * z[k : k + players], turn[1] @ z[k + players :]])
    # The scales and degrees of freedom change by a factor of two at most in a step: far off, where one of them is all but 0, nothing calls them back.
    longest = lambda q: math.log(2) / max(np.abs(turn[1] @ q[k + players :]).max(), 1e-300)
    inner = descending(np.zeros(len(start)), tolerance=1e-8, longest=longest)
    z = next(inner)
    while True:
        value, g = yield there(z)
        try:
            z = inner.send((value, np.concatenate([turn[0].T @ g[:k], width * g[k : k + players], turn[1].T @ g[k + players :]])))
        except StopIteration as e:
            return there(e.value)


def student_found(v: np.ndarray, k: int, players: int) -> dict:
    s0, s1, m = np.exp(v[k + players :])
    pace = v[k : k + players]
    return {"beta": v[:k], "pace": pace - pace.mean(), "sigma0": float(s0), "sigma1": float(s1), "nu": float(2 + m)}


def student_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, a: np.ndarray, b: np.ndarray, players: int) -> dict:
    """Posterior mode of minutes with Student-t errors whose scale grows with the root of the points (x[:, 1]), with a pace of each player.

    Paces are shrunk to 0 and add up to 0. Minimised are the weighted log density and normal priors, with their exact gradient."""
    k = x.shape[1]
    objective = lambda v: student_objective(v, student_sums(v, x, y, weight, a, b, players), k, players)
    s0, s1, root = *STUDENT_START[:2], np.sqrt(np.maximum(x[:, 1], 1.0))
    part = weight / (s0 + s1 * root) ** 2
    spreads = np.array([weight.sum(), part.sum() * s0**2, (part @ root) * s0 * s1, (part @ root**2) * s1**2])
    v = driven(student_steps((x * part[:, None]).T @ x, (x * part[:, None]).T @ y, np.bincount(a, part, players) + np.bincount(b, part, players), spreads), objective)
    return student_found(v, k, players) | {"value": objective(v)[0]}
