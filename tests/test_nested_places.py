import numpy as np

from kernelforge.operators.nested import _places


def test_places_of_repeated_points():
    x = np.array([[2.0, 1], [0, 0], [2, 1], [1, 5], [0, 0]])
    first, place = _places(x)
    assert first.tolist() == [0, 1, 3] and place.tolist() == [0, 1, 0, 2, 1] and (x[first][place] == x).all()
