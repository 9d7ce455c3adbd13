"""Plans: their nodes, text and builder front ends, rewrites and static checks."""
