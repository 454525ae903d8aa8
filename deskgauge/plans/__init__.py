"""Adapters, registered queries with their SQL counterparts, and the staged end-to-end job."""
