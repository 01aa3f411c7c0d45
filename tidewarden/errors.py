"""Errors raised by contract checks."""


class ContractError(ValueError):
    """A table breaks a rule the job depends on; the message carries the counts."""


class ContaminationError(ContractError):
    """Evaluation data reached a reference split, or attack data reached the memory."""
