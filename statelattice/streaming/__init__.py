"""Online filtering of event streams: an extension, for the forward recurrence alone needs no future."""
