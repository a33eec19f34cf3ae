"""Exact-likelihood ARMA fit of many short series at once; the task-side helper of the forecasters.

Rows of a batch are independent fits (walk-forward blocks, or orders of one series). The innovations
filter runs once over time for the whole batch, so Python never loops over series.
"""
from __future__ import annotations

import numpy as np

Z95 = 1.959963984540054
#: Fits of one pass over time, so that what a step touches stays in the processor's cache.
LANES = 4096
#: Edge of the search: partial autocorrelations up to 0.9998. A series without noise has no optimum inside.
EDGE = 50.0


def _coefficients(u, order):
    """Unconstrained numbers to stationary AR-like coefficients through partial autocorrelations."""
    batch, k = u.shape
    pac = u / np.sqrt(1.0 + u * u)
    phi = np.zeros((batch, k))
    for m in range(k):
        use = (order > m)[:, None]
        r = np.where(order > m, pac[:, m], 0.0)
        new = phi.copy()
        new[:, :m] = phi[:, :m] - r[:, None] * phi[:, :m][:, ::-1]
        new[:, m] = r
        phi = np.where(use, new, phi)
    return phi


def _filter(y, phi, theta, const, begin):
    """Innovations of y and of a constant, their variances, and the state after the last value.

    Series are right-aligned; ``begin`` is the index of the first real value of each row.
    """
    if phi.shape[1] == 1 and theta.shape[1] == 1:
        return _filter_first_order(y, phi[:, 0], theta[:, 0], const, begin)
    batch, n = y.shape
    p, q = phi.shape[1], theta.shape[1]
    r = max(p, q + 1)
    ar = np.zeros((batch, r))
    ar[:, :p] = phi
    T = np.zeros((batch, r, r))
    T[:, :, 0] = ar
    T[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    R = np.zeros((batch, r))
    R[:, 0], R[:, 1:q + 1] = 1.0, theta
    RR = R[:, :, None] * R[:, None, :]
    kron = np.einsum("bij,bkl->bikjl", T, T).reshape(batch, r * r, r * r)
    P = np.linalg.solve(np.eye(r * r) - kron, RR.reshape(batch, r * r, 1)).reshape(batch, r, r)
    a = np.zeros((batch, 2, r))
    v, F = np.empty((n, batch, 2)), np.empty((n, batch))
    live = np.arange(n)[:, None] >= begin[None, :]
    ys = np.stack([y.T, live * const.astype(float)], 2)
    settled = np.zeros(batch, bool)  # row by row, so a fit does not depend on the rows beside it
    for t in range(n):
        if not settled.all():
            f = P[:, 0, 0]
            left = ar[:, :, None] * P[:, :1, :]              # T P, using the companion form of T
            left[:, :-1] += P[:, 1:]
            K = left[:, :, 0] / f[:, None]
            new = left[:, :, :1] * ar[:, None, :] + RR       # (T P) T' + R R'
            new[:, :, :-1] += left[:, :, 1:]
            new -= K[:, :, None] * (K * f[:, None])[:, None, :]
            new = np.where((live[t] & ~settled)[:, None, None], new, P)
            settled |= (t > r + begin) & (np.abs(new - P).max(axis=(1, 2)) < 1e-9)
            P = new
        e = ys[t] - a[:, :, 0]
        v[t], F[t] = e, np.where(live[t], f, 1.0)
        nxt = a[:, :, :1] * ar[:, None, :] + e[:, :, None] * K[:, None, :]
        nxt[:, :, :-1] += a[:, :, 1:]
        a = nxt
    return v.transpose(1, 2, 0), F.T, a


def _filter_first_order(y, phi, theta, const, begin):
    """The same for ARMA(1, 1), where one number carries the state."""
    batch, n = y.shape
    v, F = np.empty((n, 2, batch)), np.empty((n, batch))
    live = np.arange(n)[:, None] >= begin[None, :]
    ys = np.stack([y.T, live * const.astype(float)], 1)
    late = begin.max()
    f = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    square, guess = theta * theta, np.zeros((2, batch))
    for t in range(n):
        e = ys[t] - guess
        guess = phi * ys[t] + e * (theta / f)
        v[t] = e
        if t < late:
            F[t] = np.where(live[t], f, 1.0)
            f = np.where(live[t], 1 + square - square / f, f)
        else:
            F[t] = f
            f = 1 + square - square / f
    state = np.zeros((batch, 2, 2))
    state[:, :, 0] = guess.T
    return v.transpose(2, 1, 0), F.T, state


def _profile(y, phi, theta, const, begin):
    """Log-likelihood with mean and variance solved out; also mean, variance and state."""
    v, F, a = _filter(y, phi, theta, const, begin)
    n = y.shape[1] - begin
    den = (v[:, 1] ** 2 / F).sum(1)
    mu = np.where(const & (den > 0), (v[:, 0] * v[:, 1] / F).sum(1) / np.where(den > 0, den, 1.0), 0.0)
    e = v[:, 0] - mu[:, None] * v[:, 1]
    s2 = np.maximum((e * e / F).sum(1) / n, 1e-300)
    llf = -0.5 * n * (np.log(2 * np.pi * s2) + 1) - 0.5 * np.log(F).sum(1)
    return llf, mu, s2, a[:, 0] - mu[:, None] * a[:, 1]


def _first_order_llf(y, phi, theta, const, begin):
    """Log-likelihood of ARMA(1, 1) as ``_profile`` gives it, without the state; ``y`` holds a row per time.

    The same operations in the same order, in place, and no column of the constant where no row has one.
    """
    n, batch = y.shape
    level = bool(const.any())
    v, F = np.empty((n, 1 + level, batch)), np.empty((n, batch))
    live = np.arange(n)[:, None] >= begin[None, :]
    late = begin.max()
    square = theta * theta
    f, top = (1 + 2 * phi * theta + square) / (1 - phi * phi), 1 + square
    gain, x = np.empty(batch), np.zeros((1 + level, batch))
    guess, turn = np.zeros_like(x), np.empty_like(x)
    if level:
        x[1] = const
    for t in range(n):
        np.divide(theta, f, out=gain)
        x[0] = y[t]
        if level and t <= late:
            x[1] = live[t] * const
        e = np.subtract(x, guess, out=v[t])
        np.multiply(e, gain, out=turn)
        np.multiply(phi, x, out=guess)
        guess += turn
        if t < late:
            F[t] = np.where(live[t], f, 1.0)
            f = np.where(live[t], 1 + square - square / f, f)
        else:
            F[t] = f
            np.divide(square, f, out=gain)
            np.subtract(top, gain, out=f)
    w, v = v[:, 1] if level else None, v[:, 0]
    size = n - begin
    if level:
        product = w * w
        product /= F
        den = product.sum(0)
        np.multiply(v, w, out=product)
        product /= F
        mu = np.where(const & (den > 0), product.sum(0) / np.where(den > 0, den, 1.0), 0.0)
        v -= mu * w
    v *= v
    v /= F
    s2 = np.maximum(v.sum(0) / size, 1e-300)
    return -0.5 * size * (np.log(2 * np.pi * s2) + 1) - 0.5 * np.log(F, out=F).sum(0)


#: A sum of squares that keeps less than this share of its terms has lost too many digits; its fit is then filtered.
CANCELLED = 1e-4
#: Starts of a search whose log-likelihoods an observation differ by less are compared by the filter.
SAME = 1e-9


def _first_order_sums(y, left, turn, slope=False):
    """What the likelihoods of ARMA(1, 1) need of series filtered by their MA part, a(t) = y(t) + turn * a(t - 1).

    Sums of a(t)^2 and of a(t) a(t - 1), the last a, and the sum of y(t) turn^t; with ``slope`` also the derivatives of the four by
    ``turn``. ``y`` holds a row per time, right-aligned, ``left`` the same left-aligned; ``turn`` any number of sets for its columns.
    """
    shape = turn.shape
    square, product, power = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    a, before, step = np.zeros(shape), np.zeros(shape), np.empty(shape)
    if slope:
        d_square, d_product, d_power, d_a, d_before = (np.zeros(shape) for _ in range(5))
    for t in range(len(y)):
        a, before = before, a
        np.multiply(before, turn, out=a)
        a += y[t]
        np.multiply(a, before, out=step)
        product += step
        np.multiply(a, a, out=step)
        square += step
        if slope:
            d_a, d_before = d_before, d_a
            np.multiply(d_before, turn, out=d_a)
            d_a += before
            np.multiply(a, d_a, out=step)
            d_square += step
            np.multiply(d_a, before, out=step)
            d_product += step
            np.multiply(a, d_before, out=step)
            d_product += step
            d_power *= turn
            d_power += power
        power *= turn
        power += left[-1 - t]
    return (square, product, a, power), (2 * d_square, d_product, d_a, d_power) if slope else None


def _power(x, n):
    """x to the n-th; the derivative that a tiny imaginary part carries stays exact for negative x too."""
    out = x.real ** n
    return out + 1j * n * x.imag * x.real ** (n - 1) if np.iscomplexobj(x) else out


def _ramp_sums(p, size):
    """Sums of g(t)^2 and of g(t) p^t over t < size, g(t) = 1 + p + ... + p^(t - 1): by doubling, as differences would cancel near p = 1."""
    at, g, power, total, squares, mixed = np.zeros_like(size), 0 * p, 1 + 0 * p, 0 * p, 0 * p, 0 * p
    for bit in range(int(size.max()).bit_length() - 1, -1, -1):
        squares = squares + at * g * g + 2 * g * power * total + power * power * squares
        total, mixed = total + at * g + power * total, mixed + power * g * g + power * power * mixed
        g, power, at = g + power * g, power * power, 2 * at
        one = (size >> bit) & 1
        squares, total, mixed, at = squares + one * g * g, total + one * g, mixed + one * g * power, at + one
        g, power = np.where(one, 1 + p * g, g), np.where(one, power * p, power)
    return squares, mixed


def _closed_llf(sums, total, size, phi, theta, const):
    """Log-likelihood of ARMA(1, 1) from the sums of its MA part, mean and variance solved out, and the share of the squares kept.

    With x(0) = y(0), x(t) = y(t) - phi y(t - 1), the series x is an MA(1) of which only the start is not known: filtered by the MA
    part its covariance is the unit matrix and a multiple of h h', h(t) = (-theta)^t, so both sums of squares and determinant
    are closed forms of ``sums``, for any ``phi``. Complex arguments give derivatives: nothing here rounds differently for them.
    """
    square, product, last, power = sums
    p = -theta
    rest, far = (1 - p) * (1 + p), _power(p, size)
    hh = (1 - far * far) / rest
    start = (theta + phi) ** 2 / (1 - phi * phi)
    taken = start / (1 + start * hh)
    h_all = (power - far * p * last) / rest                       # h' a before the AR part
    h_y = h_all - phi * (p * h_all - far * last)
    s2 = square - 2 * phi * product + phi * phi * (square - last * last) - taken * h_y * h_y
    most = (square * (1 + phi * phi)).real + 2 * np.abs(phi * product)
    if const.any():
        u, (squares, mixed) = 1 - phi, _ramp_sums(p, size)        # a constant, filtered, is u g + h
        h_1 = u * mixed + hh
        level = (total - p * last) / (1 - p)
        cross = u * (level - phi * (level - last) - h_y) / (1 - p) + h_y - taken * h_y * h_1
        den = u * u * squares + 2 * u * mixed + hh - taken * h_1 * h_1
        s2 = s2 - np.where(const & (den.real > 0), cross * cross / np.where(den.real > 0, den, 1.0), 0.0)
    kept = s2.real / np.where(most > 0, most, 1.0)
    s2 = np.where(kept > CANCELLED, s2, 1.0)                      # such a likelihood is not used
    return -0.5 * size * (np.log(2 * np.pi * s2 / size) + 1) - 0.5 * np.log(1 + start * hh), kept


def _closed_slopes(sums, slopes, total, size, phi, theta, const):
    """Derivatives of the log-likelihood by phi and by -theta, by complex steps too small to round, and the share of the squares kept."""
    tiny = 1e-30j
    by_phi, kept = _closed_llf(sums, total, size, phi + tiny, theta, const)
    by_turn, _ = _closed_llf([x + tiny * d for x, d in zip(sums, slopes)], total, size, phi, theta - tiny, const)
    return by_phi.imag / 1e-30, by_turn.imag / 1e-30, kept


def fit(y, p, q, const, lengths=None, tolerance=1e-8, closed=False):
    """Fit ARMA(p, q) (+ mean) to every row of ``y``; p, q, const hold one entry per row.

    Rows shorter than the batch are right-aligned; ``lengths`` then gives their real sizes. A row is searched until neither
    a quasi-Newton nor a plain gradient step improves its likelihood any more; every step must improve it by
    ``tolerance``, so the search ends by itself. ``converged`` is false for a row whose likelihood was never finite.

    ``closed``: ARMA(1, 1) is searched by closed forms of a few sums, several times as fast, with other rounding. Where these cancel the
    series is filtered, and a row whose filtered likelihood at the end is below that of its start keeps the start.
    """
    y = np.asarray(y, float)
    batch, n = y.shape
    size = np.full(batch, n) if lengths is None else np.asarray(lengths)
    begin = n - size
    live = np.arange(n)[None, :] >= begin[:, None]
    y = np.where(live, y, 0.0)
    mean = y.sum(axis=1) / size
    scale = np.sqrt((np.where(live, y - mean[:, None], 0.0) ** 2).sum(axis=1) / size)
    scale = np.where(scale > 0, scale, 1.0)
    z = y / scale[:, None]
    kp, kq = max(int(p.max()), 1), max(int(q.max()), 1)
    k = kp + kq
    closed = closed and k == 2
    free = np.concatenate([np.arange(kp)[None, :] < p[:, None], np.arange(kq)[None, :] < q[:, None]], 1)
    over_time = np.ascontiguousarray(z.T)
    from_start = over_time if not begin.any() else np.take_along_axis(
        np.concatenate([over_time, np.zeros((1, batch))]), np.minimum(np.arange(n)[:, None] + begin[None, :], n), axis=0)
    total = over_time.sum(axis=0)

    def filtered(phi, theta, at):
        """Log-likelihood of the rows ``at``, which may come several times, step by step."""
        out = np.empty(len(at))
        for i in range(0, len(at), LANES):
            part, here = slice(i, i + LANES), at[i:i + LANES]
            out[part] = _first_order_llf(over_time[:, here], phi[part], theta[part], const[here], begin[here])
        return out

    def likelihood(phi, theta, at, sets):
        """Of every set and row ``at``."""
        if k > 2:
            return _profile(np.tile(z[at], (sets, 1)), phi, theta, np.tile(const[at], sets), np.tile(begin[at], sets))[0]
        if not closed:
            return filtered(phi.ravel(), theta.ravel(), np.tile(at, sets))
        phi, theta = phi.reshape(sets, -1), theta.reshape(sets, -1)
        out, kept = np.empty((2, sets, len(at)))
        first = [next(j for j in range(i + 1) if np.array_equal(theta[j], theta[i])) for i in range(sets)]
        own = sorted(set(first))                  # sets with the same MA part share its sums
        which = [own.index(j) for j in first]
        some = max(1, LANES // len(own))
        for i in range(0, len(at), some):
            part, here = slice(i, i + some), at[i:i + some]
            sums, _ = _first_order_sums(over_time[:, here], from_start[:, here], -theta[own, part])
            out[:, part], kept[:, part] = _closed_llf([x[which] for x in sums], total[here], size[here], phi[:, part], theta[:, part], const[here])
        lost = np.nonzero(~(kept > CANCELLED))
        if len(lost[0]):
            out[lost] = filtered(phi[lost], theta[lost], at[lost[1]])
        return out.ravel()

    def values(stack, at):
        """Objective of a stack of parameter sets for the rows ``at``, in one pass over time."""
        sets, rows = stack.shape[:2]
        u = stack.reshape(sets * rows, k)
        phi, theta = _coefficients(u[:, :kp], np.tile(p[at], sets)), -_coefficients(u[:, kp:], np.tile(q[at], sets))
        with np.errstate(all="ignore"):
            llf = likelihood(phi, theta, at, sets)
        return np.where(np.isfinite(llf), -llf / np.tile(size[at], sets), 1e10).reshape(sets, rows)

    def numeric(u, at):
        eye = np.eye(k)[:, None, :] * 1e-5
        f = values(np.concatenate([u + eye, u - eye]), at)
        return ((f[:k] - f[k:]) / 2e-5).T * free[at]

    def gradient(u, at):
        if not closed:
            return numeric(u, at)
        out, kept, inner = np.empty(u.shape), np.empty(len(at)), u / np.sqrt(1.0 + u * u)
        phi, turn, chain = inner[:, 0] * free[at, 0], inner[:, 1] * free[at, 1], (1.0 + u * u) ** -1.5
        with np.errstate(all="ignore"):
            for i in range(0, len(at), LANES // 2 or 1):
                part = slice(i, i + (LANES // 2 or 1))
                here = at[part]
                sums, slopes = _first_order_sums(over_time[:, here], from_start[:, here], turn[part], slope=True)
                out[part, 0], out[part, 1], kept[part] = _closed_slopes(sums, slopes, total[here], size[here], phi[part], -turn[part], const[here])
            out *= chain / -size[at, None]
        lost = ~((kept > CANCELLED) & np.isfinite(out).all(axis=1))
        if lost.any():
            out[lost] = numeric(u[lost], at[lost])
        return out * free[at]

    # a coarse start keeps the search out of poor optima
    starts = np.zeros((21, batch, k))
    grid = [(ar, ma) for ar in (-1.0, -0.3, 0.3, 1.0, 3.0) for ma in (-1.0, -0.3, 0.3, 1.0)]
    for i, (ar, ma) in enumerate(grid, 1):
        starts[i, :, 0], starts[i, :, kp] = ar, ma
    starts *= free
    every = np.arange(batch)
    f = values(starts, every)
    if closed:                                    # starts with phi = -theta are all white noise: the filter says which is first
        near = f <= f.min(0) + SAME
        sets, rows = np.nonzero(near & (near.sum(0) > 1))
        if len(rows):
            at = starts[sets, rows]
            with np.errstate(all="ignore"):
                llf = filtered(_coefficients(at[:, :1], p[rows])[:, 0], -_coefficients(at[:, 1:], q[rows])[:, 0], rows)
            f[sets, rows] = np.where(np.isfinite(llf), -llf / size[rows], 1e10)
    u, best = starts[f.argmin(0), every], f.min(0)
    begun = u.copy()
    H, g = np.tile(np.eye(k), (batch, 1, 1)), gradient(u, every)
    plain = np.zeros(batch, bool)                 # the last step was a plain gradient step and failed, or is to be one
    shrink = 0.35 ** np.arange(8)
    todo = every[free.any(axis=1) & (best < 1e9)]
    while len(todo):                              # BFGS on the rows still improving, all step lengths together
        d = -np.einsum("bij,bj->bi", H[todo], g[todo])
        d = np.where((((d * g[todo]).sum(1) < 0) & ~plain[todo])[:, None], d, -g[todo])
        d /= np.maximum(1.0, np.abs(d).max(1) / 2.0)[:, None]
        cand = np.clip(u[todo] + shrink[:, None, None] * d, -EDGE, EDGE)
        f = values(cand, todo)
        pick = f.argmin(0)
        better = best[todo] - f.min(0) > tolerance
        stuck = todo[~better & plain[todo]]       # not even the plain gradient helps
        retry = todo[~better & ~plain[todo]]
        plain[retry] = True
        H[retry] = np.eye(k)
        moved = todo[better]
        if len(moved):
            nu = cand[pick, np.arange(len(todo))][better]
            ng = gradient(nu, moved)
            s, yv = nu - u[moved], ng - g[moved]
            sy = (s * yv).sum(1)
            ok = sy > 1e-12
            rho = np.where(ok, 1.0 / np.where(ok, sy, 1.0), 0.0)
            V = np.eye(k) - rho[:, None, None] * s[:, :, None] * yv[:, None, :]
            H[moved] = np.where(ok[:, None, None], V @ H[moved] @ V.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :], H[moved])
            u[moved], best[moved], g[moved] = nu, f.min(0)[better], ng
            plain[moved] = False
        todo = np.setdiff1d(todo, stuck, assume_unique=True)
    phi, theta = _coefficients(u[:, :kp], p), -_coefficients(u[:, kp:], q)
    if closed:
        first = _coefficients(begun[:, :kp], p), -_coefficients(begun[:, kp:], q)
        with np.errstate(all="ignore"):
            worse = filtered(phi[:, 0], theta[:, 0], every) < filtered(first[0][:, 0], first[1][:, 0], every)
        phi, theta = (np.where(worse[:, None], was, now) for was, now in zip(first, (phi, theta)))
    llf, mu, s2, state = _profile(z, phi, theta, const, begin)
    llf = llf - size * np.log(scale)
    return {"phi": phi, "theta": theta, "mu": mu * scale, "s2": s2 * scale ** 2, "state": state * scale[:, None],
            "llf": llf, "aic": -2 * llf + 2 * (p + q + const + 1), "converged": best < 1e9}


def forecast(model, steps, integrate_from=None):
    """Mean and deviation of the next ``steps`` values; ``integrate_from`` undoes one differencing."""
    phi, theta, a = model["phi"], model["theta"], model["state"].copy()
    batch, p = phi.shape
    r = a.shape[1]
    psi_state = np.zeros((batch, r))
    psi_state[:, 0], psi_state[:, 1:theta.shape[1] + 1] = 1.0, theta
    mean, psi = np.empty((batch, steps)), np.empty((batch, steps))
    for h in range(steps):
        for s, out in ((a, mean), (psi_state, psi)):
            out[:, h] = s[:, 0]
            head = s[:, :1].copy()
            s[:, :-1] = s[:, 1:]
            s[:, -1] = 0.0
            s[:, :p] += head * phi
    mean = mean + model["mu"][:, None]
    if integrate_from is not None:
        mean = np.asarray(integrate_from)[:, None] + np.cumsum(mean, 1)
        psi = np.cumsum(psi, 1)
    return mean, np.sqrt(model["s2"][:, None] * np.cumsum(psi ** 2, 1))
