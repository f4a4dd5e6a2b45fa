"""Faults as values: the kind is part of the contract, the message isn't."""

KINDS = ("Codestream", "Marker", "Unsupported", "Packet", "Tier1", "Inconsistent")


class Fault(Exception):
    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message = kind, message


def codestream(message: str) -> Fault:
    return Fault("Codestream", message)


def marker(message: str) -> Fault:
    return Fault("Marker", message)


def unsupported(message: str) -> Fault:
    return Fault("Unsupported", message)


def inconsistent(message: str) -> Fault:
    return Fault("Inconsistent", message)
