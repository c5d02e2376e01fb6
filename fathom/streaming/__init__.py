"""Online forms of some operators: an addition of this library, not part of the batch plans."""
