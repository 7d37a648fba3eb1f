"""Plan building blocks that keep hot keys and small tables in check, and the end-to-end flows built from operators."""
