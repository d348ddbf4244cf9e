"""The same over streams; an extension, as the batch forms come first."""
