"""Record streams and stateful operators."""
