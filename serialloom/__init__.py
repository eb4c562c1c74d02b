"""Set-based maintenance of a catalogue of serialised books on Spark."""
