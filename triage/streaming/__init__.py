"""The same operators fed by streams."""
