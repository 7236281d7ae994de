"""Errors raised on the driver; per-row problems go to violation columns instead."""


class SylvanError(Exception):
    pass


class SummarizationError(SylvanError):
    pass


class ClusteringError(SylvanError):
    pass


class VerificationError(SylvanError):
    pass
