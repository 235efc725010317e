"""A bounded memory of computed values, for work inside tasks."""

from collections.abc import Callable


class Recent:
    """Values of keys, computed in lots when first met. Two generations of at most about bound keys are kept: what is
    met again moves to the young one, what is not goes with the old one."""

    def __init__(self, compute: Callable[[list], list], bound: int):
        self.compute, self.bound, self.young, self.old = compute, bound, {}, {}

    def many(self, keys: list) -> list:
        young, old = self.young, self.old
        missing = set(keys).difference(young)
        if missing:
            young.update([(k, old[k]) for k in missing if k in old])
            new = [k for k in missing if k not in young]
            young.update(zip(new, self.compute(new), strict=True))
        out = list(map(young.__getitem__, keys))
        if len(young) > self.bound:
            self.old, self.young = young, {}
        return out
