"""Result files that arrive one batch at a time."""
