"""Where contracts come from.  Rows come from any DataFrame that the caller reads, and go where the caller writes."""
