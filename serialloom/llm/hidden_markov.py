"""Hidden Markov chains over symbols, in numpy: exact forward, Baum-Welch counts.

Sequences are run side by side, sorted by length, so that a step in time is one small
matrix product for all that are still running. What doesn't depend on the step before is
done for a whole stretch of time at once: looking up emissions, and adding up what is
expected. The forward recursion is scaled every few steps, and where a sequence ends; the
logarithms of the norms add up to its likelihood. For Baum-Welch only the forward rows of
one stretch are held; those before are made again from the row where the stretch starts,
so memory doesn't grow with a sequence.
"""

import numpy as np

#: Steps of a stretch; rows are scaled at its end, and every SCALED steps.
STRETCH, SCALED = 128, 4
#: Sequences run side by side; fewer when they are long, for the rows of a stretch and the
#: symbols of the whole.
BESIDE, CELLS, LAID_OUT = 2048, 200_000, 12_000_000


class Chain:
    """start (K), move (K x K), emit (symbols x K): rows of start and move sum to 1, columns of emit too."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit)

    @classmethod
    def random(cls, states: int, frequency: np.ndarray, seed: int = 5, stay: float = 0.97) -> "Chain":
        """Every state emits the frequencies, each symbol by a random factor; states last."""
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * rng.uniform(0.3, 1.7, (len(frequency), states))
        move = np.full((states, states), (1 - stay) / max(1, states - 1))
        np.fill_diagonal(move, stay if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _beside(sequences: list[np.ndarray]):
    """Indices of sequences to run together: of similar length, longest first."""
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        n = max(1, min(BESIDE, CELLS // min(longest, STRETCH), LAID_OUT // longest))
        yield order[at : at + n]
        at += n


def _laid_out(sequences: list[np.ndarray]):
    """(symbols, live): time by sequence, longest first, and how many run at each time; none
    after the last."""
    lengths = np.array([len(s) for s in sequences])
    symbols = np.zeros((lengths[0], len(sequences)), sequences[0].dtype)
    for i, s in enumerate(sequences):
        symbols[: len(s), i] = s
    live = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), side="left")
    return symbols, live


class _Stretch:
    """The forward rows of one stretch of time, one after the other; ``live`` has one entry
    more than ``symbols``, for the step behind the stretch."""

    def __init__(self, chain: Chain, symbols: np.ndarray, live: np.ndarray, head: np.ndarray | None, logs: np.ndarray):
        self.chain, self.live, self.head = chain, live.tolist(), head
        runs = np.arange(symbols.shape[1])
        self.running = runs < live[:-1, None]
        self.symbols = symbols[self.running].astype(np.intp)
        self.ends = np.cumsum(live[:-1]).tolist()
        self.emitted = chain.emit.take(self.symbols, axis=0)
        self.alpha = np.empty_like(self.emitted)
        self.norms: dict[int, np.ndarray] = {}
        #: by step, the sums of the rows of sequences that end there
        self.last: dict[int, np.ndarray] = {}
        ones, before = np.ones(len(chain.start)), head
        for t in range(len(symbols)):
            n, after = self.live[t], self.live[t + 1]
            a = self.alpha[self.ends[t] - n : self.ends[t]]
            if before is None:
                a[:] = chain.start
            else:
                np.matmul(before[:n], chain.move, out=a)
            a *= self.emitted[self.ends[t] - n : self.ends[t]]
            if (t + 1) % SCALED == 0 or t + 1 == len(symbols):
                self.norms[t] = norm = a @ ones
                a /= norm[:, None]
                logs[:n] += np.log(norm)
            if after < n:
                self.last[t] = rest = a[after:] @ ones
                logs[after:n] += np.log(rest)
            before = a
        self.tail = before.copy()

    def add_to(self, counts: "Counts", beta: np.ndarray | None) -> np.ndarray:
        """Add what is expected in this stretch; ``beta`` is of its last step, for sequences
        that go on behind it. Returns that of the step before the stretch."""
        chain, ahead, live = self.chain, self.emitted, self.live
        betas = np.empty_like(self.alpha)
        back, moved = beta, np.ascontiguousarray(chain.move.T)
        for t in range(len(self.ends) - 1, -1, -1):
            n, after = live[t], live[t + 1]
            rows = slice(self.ends[t] - n, self.ends[t])
            b = betas[rows]
            if after and back is not None:
                b[:after] = back
            if after < n:
                b[after:] = 1 / self.last[t][:, None]
            # what the state before must move to, and emit here
            ahead[rows] *= b
            if t in self.norms:
                ahead[rows] /= self.norms[t][:, None]
            if t:
                back = np.matmul(ahead[rows], moved, out=betas[self.ends[t - 1] - live[t - 1] :][:n])
        first = live[0]
        goes_on = (np.arange(self.running.shape[1]) < np.array(live[1:])[:, None])[self.running]
        goes_on[self.ends[-1] - live[-2] :] = False
        before = self.alpha.take(np.flatnonzero(goes_on), axis=0)
        counts.move += chain.move * (before.T @ ahead[first:])
        if self.head is not None:
            counts.move += chain.move * (self.head[:first].T @ ahead[:first])
        gamma = np.multiply(self.alpha, betas, out=betas)
        if self.head is None:
            counts.start += gamma[:first].sum(axis=0)
        for k, of_state in enumerate(np.ascontiguousarray(gamma.T)):
            counts.emit[:, k] += np.bincount(self.symbols, of_state, len(counts.emit))
        return ahead[:first] @ moved


def _cuts(symbols: np.ndarray) -> range:
    return range(0, len(symbols), STRETCH)


def log_likelihoods(chain: Chain, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each sequence's probability; 0 for empty ones."""
    out = np.zeros(len(sequences))
    for group in _beside(sequences):
        symbols, live = _laid_out([sequences[i] for i in group])
        logs, head = np.zeros(len(group)), None
        for at in _cuts(symbols):
            head = _Stretch(chain, symbols[at : at + STRETCH], live[at : at + STRETCH + 1], head, logs).tail
        out[group] = logs
    return out


class Counts:
    """Expected counts of a chain's starts, moves and emissions."""

    def __init__(self, states: int, symbols: int):
        self.start, self.move = np.zeros(states), np.zeros((states, states))
        self.emit, self.log = np.zeros((symbols, states)), 0.0

    def add(self, chain: Chain, sequences: list[np.ndarray]):
        for group in _beside(sequences):
            self._add(chain, [sequences[i] for i in group])

    def _add(self, chain: Chain, sequences: list[np.ndarray]):
        symbols, live = _laid_out(sequences)

        def stretch(at: int, head: np.ndarray | None, logs: np.ndarray) -> _Stretch:
            return _Stretch(chain, symbols[at : at + STRETCH], live[at : at + STRETCH + 1], head, logs)

        logs, heads, head, last = np.zeros(len(sequences)), [], None, None
        for at in _cuts(symbols):
            heads.append(head)
            last = None  # only one stretch is held
            last = stretch(at, head, logs)
            head = last.tail
        self.log += logs.sum()
        beta, unused = None, np.zeros(len(sequences))
        for at, head in zip(reversed(_cuts(symbols)), reversed(heads), strict=True):
            part = stretch(at, head, unused) if last is None else last
            last = None
            beta = part.add_to(self, beta)

    def chain(self, frequency: np.ndarray, pull: float = 200.0) -> Chain:
        """The re-estimated chain; emissions are pulled towards the frequencies, so none is 0."""
        start = (self.start + 0.1) / (self.start + 0.1).sum()
        move = self.move + 0.1
        emit = self.emit + pull * frequency[:, None]
        return Chain(start, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))
