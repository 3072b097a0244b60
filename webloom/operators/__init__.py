from webloom.operators.bag import Bag, Pairs

__all__ = ["Bag", "Pairs"]
