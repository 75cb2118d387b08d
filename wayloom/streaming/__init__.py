"""An extension: trip requests as a stream."""
