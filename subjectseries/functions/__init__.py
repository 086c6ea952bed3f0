from subjectseries.functions import predicates, scalars

__all__ = ["predicates", "scalars"]
